"""Preferred units and conversions.

Both tables are fixed text and small, so the joins that use them broadcast
them whatever the size of the data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import QUANTITY_PREFIX

# --- fixed values ----------------------------------------------------------
# Preferred unit of each quantity.
PREFERRED_UNITS = {
    "StepCount": "count",
    "DistanceWalkingRunning": "m",
    "DistanceCycling": "m",
    "DistanceSwimming": "m",
    "ActiveEnergyBurned": "kcal",
    "BasalEnergyBurned": "kcal",
    "HeartRate": "count/min",
    "RestingHeartRate": "count/min",
    "WalkingHeartRateAverage": "count/min",
    "HeartRateVariabilitySDNN": "ms",
    "OxygenSaturation": "%",
    "BloodPressureSystolic": "mmHg",
    "BloodPressureDiastolic": "mmHg",
    "RespiratoryRate": "count/min",
    "BodyMass": "kg",
    "BodyMassIndex": "count",
    "BodyFatPercentage": "%",
    "Height": "m",
    "LeanBodyMass": "kg",
    "WaistCircumference": "m",
    "BloodGlucose": "mg/dL",
    "BodyTemperature": "degC",
    "BasalBodyTemperature": "degC",
    "FlightsClimbed": "count",
    "PushCount": "count",
    "VO2Max": "ml/kg·min",
    "AppleExerciseTime": "min",
    "AppleStandTime": "min",
    "AppleMoveTime": "min",
    "UVExposure": "count",
    "EnvironmentalAudioExposure": "dBASPL",
    "HeadphoneAudioExposure": "dBASPL",
    "DietaryEnergyConsumed": "kcal",
    "DietaryWater": "L",
    "DietaryCaffeine": "mg",
    "SixMinuteWalkTestDistance": "m",
    "WalkingSpeed": "m/s",
    "StairAscentSpeed": "m/s",
    "StairDescentSpeed": "m/s",
    "WalkingAsymmetryPercentage": "%",
    "WalkingDoubleSupportPercentage": "%",
    "AppleWalkingSteadiness": "%",
    "WalkingStepLength": "m",
    "DistanceDownhillSnowSports": "m",
    "DistanceWheelchair": "m",
    "SwimmingStrokeCount": "count",
    "NikeFuel": "count",
    "PeripheralPerfusionIndex": "%",
    "ForcedVitalCapacity": "L",
    "ForcedExpiratoryVolume1": "L",
    "PeakExpiratoryFlowRate": "L/min",
    "InhalerUsage": "count",
    "BloodAlcoholContent": "%",
    "NumberOfTimesFallen": "count",
    "AtrialFibrillationBurden": "%",
    "CyclingPower": "W",
    "RunningPower": "W",
    "CyclingFunctionalThresholdPower": "W",
    "CyclingCadence": "count/min",
    "CyclingSpeed": "m/s",
    "RunningSpeed": "m/s",
    "RunningStrideLength": "m",
    "RunningVerticalOscillation": "cm",
    "RunningGroundContactTime": "ms",
    "UnderwaterDepth": "m",
    "WaterTemperature": "degC",
    "TimeInDaylight": "min",
    "PhysicalEffort": "kcal/hr·kg",
}
# Units tried, in this order, for a quantity without a usable preferred unit.
FALLBACK_UNITS = ("count", "kcal", "m", "kg", "%", "s", "min", "L", "degC", "mmHg",
                  "count/min", "W", "m/s", "L/min")
# Each unit's dimension and its size in the dimension's base unit:
# base = value * factor + offset.
UNIT_SIZES = {
    "count": ("count", 1.0, 0.0),
    "%": ("fraction", 1.0, 0.0),
    "m": ("length", 1.0, 0.0),
    "cm": ("length", 0.01, 0.0),
    "mm": ("length", 0.001, 0.0),
    "km": ("length", 1000.0, 0.0),
    "in": ("length", 0.0254, 0.0),
    "ft": ("length", 0.3048, 0.0),
    "yd": ("length", 0.9144, 0.0),
    "mi": ("length", 1609.344, 0.0),
    "kg": ("mass", 1.0, 0.0),
    "g": ("mass", 0.001, 0.0),
    "mg": ("mass", 0.000001, 0.0),
    "mcg": ("mass", 0.000000001, 0.0),
    "lb": ("mass", 0.45359237, 0.0),
    "oz": ("mass", 0.028349523125, 0.0),
    "st": ("mass", 6.35029318, 0.0),
    "kcal": ("energy", 1.0, 0.0),
    "Cal": ("energy", 1.0, 0.0),
    "cal": ("energy", 0.001, 0.0),
    "kJ": ("energy", 0.2390057361376673, 0.0),
    "J": ("energy", 0.0002390057361376673, 0.0),
    "s": ("time", 1.0, 0.0),
    "ms": ("time", 0.001, 0.0),
    "min": ("time", 60.0, 0.0),
    "hr": ("time", 3600.0, 0.0),
    "L": ("volume", 1.0, 0.0),
    "mL": ("volume", 0.001, 0.0),
    "fl_oz_us": ("volume", 0.0295735295625, 0.0),
    "degC": ("temperature", 1.0, 0.0),
    "degF": ("temperature", 0.5555555555555556, -17.77777777777778),
    "K": ("temperature", 1.0, -273.15),
    "mmHg": ("pressure", 1.0, 0.0),
    "kPa": ("pressure", 7.500615758456564, 0.0),
    "count/min": ("frequency", 1.0, 0.0),
    "count/s": ("frequency", 60.0, 0.0),
    "W": ("power", 1.0, 0.0),
    "kW": ("power", 1000.0, 0.0),
    "m/s": ("speed", 1.0, 0.0),
    "km/hr": ("speed", 0.2777777777777778, 0.0),
    "mi/hr": ("speed", 0.44704, 0.0),
    "L/min": ("flow", 1.0, 0.0),
    "mg/dL": ("glucose", 1.0, 0.0),
    "mmol<180.15588000005408>/L": ("glucose", 18.015588, 0.0),
    "ml/kg·min": ("oxygen uptake", 1.0, 0.0),
    "dBASPL": ("sound pressure", 1.0, 0.0),
    "kcal/hr·kg": ("effort", 1.0, 0.0),
}


def preferred_units(spark: SparkSession) -> DataFrame:
    """metric_type -> preferred_unit."""
    rows = [{"metric_type": QUANTITY_PREFIX + name, "preferred_unit": unit} for name, unit in PREFERRED_UNITS.items()]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def unit_conversions(spark: SparkSession) -> DataFrame:
    """(from_unit, to_unit) -> factor, offset for units of one dimension, plus the
    fallback unit of each `from_unit`'s dimension."""
    fallback = {}
    for unit in FALLBACK_UNITS:
        fallback.setdefault(UNIT_SIZES[unit][0], unit)
    rows = []
    for src, (dim, factor, offset) in UNIT_SIZES.items():
        for dst, (dst_dim, dst_factor, dst_offset) in UNIT_SIZES.items():
            if dim == dst_dim:
                rows.append({"from_unit": src, "to_unit": dst, "factor": factor / dst_factor,
                             "shift": (offset - dst_offset) / dst_factor, "is_fallback": fallback.get(dim) == dst})
    return spark.createDataFrame(pa.Table.from_pylist(rows))
