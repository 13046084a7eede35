"""Errors of the public interface."""


class RecordingExistsError(FileExistsError):
    """The output folder already holds a finished recording."""


class FieldNotFoundError(KeyError):
    """No such field, log or child table."""


class InvalidRecordingError(ValueError):
    """The folder or archive is no recording."""


class SliceError(RuntimeError):
    """A byte range could not be decoded."""

    def __init__(self, message: str, slice_no: int, byte_range: tuple[int, int]) -> None:
        super().__init__(f"{message} (slice {slice_no}, bytes {byte_range[0]}-{byte_range[1]})")
        self.slice_no, self.byte_range = slice_no, byte_range


class WriteError(RuntimeError):
    """A sink failed."""


class RebuildError(RuntimeError):
    """A recording lacks what is needed to rebuild its log."""
