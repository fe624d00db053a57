"""What can go wrong with a recording; one base class to catch."""

from __future__ import annotations


class MdfError(ValueError):
    """Base of all errors of this library."""


class NotMdf(MdfError):
    """The file does not begin as an MDF file does."""


class OldVersion(MdfError):
    """The file is of a version before 4.10."""


class ShortRead(MdfError):
    """Bytes were asked for that lie beyond the end."""


class WrongBlock(MdfError):
    """A link leads to a block of another kind."""


class CompressedData(MdfError):
    """Data in ##DZ or ##HZ blocks is not read."""


class ChainTooDeep(MdfError):
    """Conversions nest deeper than 20."""


class ChainCycle(MdfError):
    """A conversion refers to itself."""


class NotFound(MdfError):
    """No group or channel has this name or number."""


class BeyondEnd(MdfError):
    """Records were asked for that the group does not hold."""


class NoStartTime(MdfError):
    """The recording has no start time."""


class NoSource(MdfError):
    """An index without a file or address can't be read from."""


class CannotWrite(MdfError):
    """A type that has no channel type here."""
