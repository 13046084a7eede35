"""Receiver-log analytics on Spark DataFrames."""

from almagest.errors import FieldNotFoundError, InvalidRecordingError, RebuildError, RecordingExistsError, SliceError, WriteError
from almagest.functions.gpstime import GpsTime
from almagest.operators.verify import SourceCheck, same_source
from almagest.operators.views import VIEWS
from almagest.plans.catalog import Recording, SchemaNames
from almagest.plans.table import LogTable
from almagest.progress import Progress, Tracker
from almagest.report import Verification, verify
from almagest.sources.rebuild import rebuild
from almagest.sources.writer import RecordingWriter, convert

__all__ = [
    "VIEWS", "FieldNotFoundError", "GpsTime", "InvalidRecordingError", "LogTable", "Progress", "RebuildError", "Recording", "RecordingExistsError", "RecordingWriter",
    "SchemaNames", "SliceError", "SourceCheck", "Tracker", "Verification", "WriteError", "convert", "rebuild", "same_source", "verify",
]
