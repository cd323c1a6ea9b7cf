"""Runtime version rules (D3, X2, X4, X6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lowest runtime the new catalog supports, and the fixed
# runtimes a custom image is moved to.
FLOOR = (13, 3)
CUSTOM_GPU_ML = "13.3.x-gpu-ml-scala2.12"
CUSTOM_CPU_ML = "13.3.x-cpu-ml-scala2.12"
CUSTOM_PLAIN = "13.3.x-scala2.12"


def version_number(v: Column) -> Column:
    """Text before the first ``.x`` (``13.10.x-cpu-ml`` -> ``13.10``)."""
    return F.substring_index(v, ".x", 1)


def version_suffix(v: Column) -> Column:
    """Text after the last ``.x`` (``13.10.x-cpu-ml`` -> ``-cpu-ml``)."""
    return F.substring_index(v, ".x", -1)


def floor_version(v: Column, floor: tuple[int, int] = FLOOR, custom_gpu_ml: str = CUSTOM_GPU_ML,
                  custom_cpu_ml: str = CUSTOM_CPU_ML, custom_plain: str = CUSTOM_PLAIN) -> Column:
    """D3: a plain ``major.minor.x<suffix>`` version below ``floor`` becomes
    ``floor.x<suffix>``; one at or above it stays.  Versions compare as
    (major, minor) integers, so 13.10 is above 13.3.  A ``custom`` version
    becomes the fixed gpu-ml, cpu-ml or plain runtime.  Anything else (no
    ``.x``, not a number) is left as it is."""
    nbr = version_number(v)
    parts = F.split(nbr, "\\.")
    major = F.try_element_at(parts, F.lit(1)).try_cast("int")
    minor = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    plain = v.contains(".x") & nbr.rlike("^[0-9]+(\\.[0-9]+)?$")
    below = (major < floor[0]) | ((major == floor[0]) & (minor < floor[1]))
    floored = F.concat(F.lit(f"{floor[0]}.{floor[1]}.x"), version_suffix(v))
    custom = (F.when(v.contains("ml") & v.contains("gpu"), F.lit(custom_gpu_ml))
               .when(v.contains("ml"), F.lit(custom_cpu_ml))
               .otherwise(F.lit(custom_plain)))
    return (F.when(v.isNull(), v)
             .when(v.contains("custom"), custom)
             .when(plain & below, floored)
             .otherwise(v))


def is_ml(v: Column) -> Column:
    return F.coalesce(v.contains("ml"), F.lit(False))
