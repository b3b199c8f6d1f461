"""Personal-biometrics analytics as plain PySpark DataFrame functions.

Every public function takes DataFrames plus ordinary arguments and returns a
lazy DataFrame.  Nothing here collects rows to the driver.
"""

__version__ = "0.1.0"
