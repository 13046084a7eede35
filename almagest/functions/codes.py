"""Code tables of the receiver logs. Fixed values of the log format, in their natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION_TYPES = {
    0: "None", 1: "Fixed Pos", 2: "Fixed Height", 8: "Doppler Velocity", 16: "Single", 17: "PSR Diff", 18: "WAAS", 19: "Propagated", 20: "OmniSTAR",
    32: "L1 Float", 33: "Iono-Free Float", 34: "Narrow Float", 48: "L1 Int", 49: "Wide Int", 50: "Narrow Int", 51: "RTK Direct INS", 52: "INS SBAS",
    53: "INS PSR SP", 54: "INS PSR Diff", 55: "INS RTK Float", 56: "INS RTK Fixed", 57: "INS OmniSTAR", 60: "OmniSTAR HP", 61: "OmniSTAR XP",
    64: "PPP Converging", 65: "PPP", 69: "INS PPP Converging", 70: "INS PPP", 77: "PPP Basic Converging", 78: "PPP Basic",
}
SOLUTION_STATUSES = {
    0: "SOL_COMPUTED", 1: "INSUFFICIENT_OBS", 2: "NO_CONVERGENCE", 3: "SINGULARITY", 4: "COV_TRACE", 5: "TEST_DIST", 6: "COLD_START", 7: "V_H_LIMIT",
    8: "VARIANCE", 9: "RESIDUALS", 13: "INTEGRITY_WARNING", 18: "PENDING", 20: "INVALID_FIX", 21: "UNAUTHORIZED", 22: "ANTENNA_WARNING",
}
#: By the system field of a channel status.
CHANNEL_SYSTEMS = {0: "GPS", 1: "GLONASS", 2: "SBAS", 3: "Galileo", 4: "BeiDou", 5: "QZSS", 6: "NavIC"}
CHANNEL_PREFIXES = {0: "G", 1: "R", 2: "S", 3: "E", 4: "C", 5: "J", 6: "N"}
#: By the system type of a visibility log; its codes differ from the channel status.
SKY_SYSTEMS = {"0": "GPS", "1": "GLONASS", "2": "SBAS", "5": "BeiDou", "6": "QZSS", "7": "Galileo"}
SKY_PREFIXES = {"0": "G", "1": "R", "2": "S", "5": "C", "6": "J", "7": "E"}


def named(code: Column, names: dict, unknown: Column | None = None) -> Column:
    """The code's name; ``unknown`` (by default the code as text) where it has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    key = code.cast("string") if isinstance(next(iter(names)), str) else F.try_to_number(code.cast("string"), F.lit("999999999")).cast("int")
    return F.coalesce(F.when(key.isNotNull(), F.element_at(table, key)), unknown if unknown is not None else code.cast("string"))


def system_id(channel_status: Column) -> Column:
    return F.shiftright(channel_status.cast("long"), 16).bitwiseAND(F.lit(7)).cast("int")


def system_name(channel_status: Column) -> Column:
    number = system_id(channel_status)
    return named(number, CHANNEL_SYSTEMS, F.concat(F.lit("Unknown("), number.cast("string"), F.lit(")")))


def satellite_label(prefix: Column, prn: Column) -> Column:
    return F.concat(prefix, F.lpad(prn.cast("string"), 2, "0"))


def signal_band(mean_cn0: Column) -> Column:
    """Poor under 20 dB-Hz, warning under 30, good to 60; above that it may be spoofing or multipath."""
    return F.when(mean_cn0 < 20, "poor").when(mean_cn0 < 30, "warning").when(mean_cn0 <= 60, "good").when(mean_cn0 > 60, "suspicious")
