"""Column expressions on log and audit lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log layout "yy/MM/dd HH:mm:ss LEVEL Logger: message" as a pattern, its time format,
# and the header of a printed stream batch with its "(word,count)" rows.
LOG_LINE = r"^(\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) ([A-Z]+) ([^:\s]+): (.*)$"
LOG_TIME = "yy/MM/dd HH:mm:ss"
BATCH_HEADER = r"^Time: (\d+) ms$"
BATCH_PAIR = r"^\((.*),(-?\d+)\)$"

# The parts of a login line of the sign-in proxy.
LOGIN_LINE = (
    r"^(\S+?)(?::\d+)? - (\S+) - (\S+) \[(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\] \[AuthSuccess\] "
    r"Authenticated via OAuth2: Session\{"
)
SESSION_TIME = r"\b%s:(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)"
SESSION_GROUPS = r"\bgroups:\[([^\]]*)\]"


def part(value: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null when the pattern does not match."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))


_MARK = "\x01"


def head_parts(value: Column) -> Column:
    """Time, level, logger and message of a record's first line as an array, null for other lines. Only a line that
    passes the test is matched again, for all its parts at once."""
    marked = F.regexp_replace(value, LOG_LINE, _MARK.join(f"${n}" for n in range(1, 5)))
    return F.when(value.rlike(LOG_LINE), F.split(marked, _MARK, 4))


def log_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(LOG_TIME))


def session_time(value: Column, name: str) -> Column:
    """``created`` or ``expires`` of a login line, cut to microseconds."""
    return part(value, SESSION_TIME % name, 1).try_cast("timestamp")


def session_groups(value: Column) -> Column:
    listed = part(value, SESSION_GROUPS, 1)
    return F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, " "))
