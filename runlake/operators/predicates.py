"""Filters as column expressions, to be combined with & | ~; Catalyst pushes down what the source supports."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlake.functions.columns import json_text

SLOW_SECONDS = 5.0
#: Signs of a text that the indexed search looks at.
INDEXED = 250


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions, F.lit(False))


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)


def eq(c: Column | str, value) -> Column:
    return _col(c).isNull() if value is None else _col(c) == value


def neq(c: Column | str, value) -> Column:
    return _col(c).isNotNull() if value is None else _col(c) != value


def has(c: Column | str, value: str) -> Column:
    return F.array_contains(_col(c), value)


def failed(error: Column | str = "error") -> Column:
    return _col(error).isNotNull()


def succeeded(error: Column | str = "error") -> Column:
    return _col(error).isNull()


def time_window(start: Column | str = "start_time", *, since: datetime | None = None, before: datetime | None = None, last: timedelta | None = None, now: datetime | None = None, inclusive: bool = False) -> Column:
    """Runs of a window: `since` + `last` looks forward from since, `before` + `last` back from before, `last` alone back from `now`.

    Bounds are strict unless `inclusive`. All three at once contradict each other.
    """
    if since is not None and before is not None and last is not None:
        raise ValueError("give at most two of since, before and last")
    low, high = since, before
    if last is not None:
        if since is not None:
            high = since + last
        elif before is not None:
            low = before - last
        else:
            if now is None:
                raise ValueError("`last` alone needs `now`")
            low = now - last
    t, out = _col(start).cast("timestamp"), []
    for bound, strict, loose in ((low, Column.__gt__, Column.__ge__), (high, Column.__lt__, Column.__le__)):
        if bound is not None:
            out.append((loose if inclusive else strict)(t, F.lit(bound.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")))
    return all_of(*out)


def latency_between(latency: Column | str = "latency_s", low: float | None = None, high: float | None = None) -> Column:
    c = _col(latency)
    return all_of(*([c > low] if low is not None else []), *([c < high] if high is not None else []))


def slow(latency: Column | str = "latency_s") -> Column:
    return latency_between(latency, SLOW_SECONDS)


def recent(now: datetime, start: Column | str = "start_time") -> Column:
    return time_window(start, last=timedelta(hours=1), now=now)


def today(now: datetime, start: Column | str = "start_time") -> Column:
    return time_window(start, since=now.replace(hour=0, minute=0, second=0, microsecond=0))


def has_all_tags(wanted: Iterable[str], tags: Column | str = "tags") -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), _col(tags))) == 0, F.lit(False))


def glob_pattern(glob: str, sets: bool = True) -> str:
    """A whole-text regular expression of a glob: * and ?, and with `sets` also [seq] and [!seq]."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if sets and c == "[" else -1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return f"^{''.join(out)}$"


def checked_regex(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {pattern!r} ({e})") from e
    return pattern


def name_matches(name: Column | str = "name", *, exact: str | None = None, regex: str | None = None, glob: str | None = None, contains: str | None = None, default: str | None = None) -> Column:
    """An exact name wins over everything; else regex, glob and contains must all hold; else the default name. Null matches nothing."""
    c = _col(name)
    if exact is not None:
        return F.coalesce(c == exact, F.lit(False))
    out = []
    if regex is not None:
        out.append((c != "") & c.rlike(checked_regex(regex)))
    if glob is not None:
        out.append(c.rlike(glob_pattern(glob)))
    if contains is not None:
        out.append(c.contains(contains))
    if not out and default is not None:
        out.append(c == default)
    return F.coalesce(all_of(*out), F.lit(False))


def excludes(parts: Iterable[str], name: Column | str = "name") -> Column:
    return none_of(*(F.coalesce(_col(name), F.lit("")).contains(p) for p in parts))


def metadata_is(key: str, value: str, metadata: Column | str = "metadata") -> Column:
    return F.coalesce(_col(metadata)[key] == value, F.lit(False))


def metadata_like(key: str, glob: str, metadata: Column | str = "metadata") -> Column:
    """A missing key counts as an empty value, so * matches it."""
    return F.coalesce(_col(metadata)[key], F.lit("")).rlike(glob_pattern(glob))


def value_matches(c: Column, pattern: str) -> Column:
    """By /regex/, by a glob with * or ?, else exactly; a broken regex is compared exactly."""
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        try:
            return c.rlike(checked_regex(pattern[1:-1]))
        except ValueError:
            return c == pattern
    return c.rlike(glob_pattern(pattern, sets=False)) if "*" in pattern or "?" in pattern else c == pattern


def metadata_or_tag(key: str, pattern: str, metadata: Column | str = "metadata", tags: Column | str = "tags", context: Column | str | None = None) -> Column:
    """A key's value in the metadata, in a tag (by itself or after `key:`) or in the trace's context."""
    sources = [F.coalesce(value_matches(_col(metadata)[key], pattern), F.lit(False))]
    after = F.lit(len(key) + 2)
    sources.append(F.coalesce(F.exists(_col(tags), lambda t: value_matches(t, pattern) | (t.startswith(f"{key}:") & value_matches(F.substr(t, after), pattern))), F.lit(False)))
    if context is not None:
        sources.append(F.coalesce(value_matches(_col(context)[key], pattern), F.lit(False)))
    return any_of(*sources)


def grep(pattern: str, *columns: Column | str, ignore_case: bool = False, regex: bool = False) -> Column:
    """A literal text or regular expression within the JSON text of the columns."""
    text = json_text(*columns)
    if regex:
        return text.rlike(("(?i)" if ignore_case else "") + checked_regex(pattern))
    return F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)


def search(query: str, *columns: Column | str) -> Column:
    """The query within the first INDEXED signs of any column, in any case."""
    return any_of(*(F.coalesce(F.lower(F.left(_col(c), F.lit(INDEXED))).contains(query.lower()), F.lit(False)) for c in columns))


def search_in(query: str, scope: str, ignore_case: bool = True) -> Column:
    """The query anywhere in inputs, outputs or error."""
    if scope not in ("inputs", "outputs", "error"):
        raise ValueError(f"cannot search in {scope!r}")
    c = F.coalesce(F.col(scope), F.lit(""))
    return F.lower(c).contains(query.lower()) if ignore_case else c.contains(query)


def is_root(parent: Column | str = "parent_run_id") -> Column:
    return _col(parent).isNull()


def root_scope(roots: bool | None = None, trace_id: str | None = None, parent_id: str | None = None) -> Column:
    """Which part of traces is meant; roots below a parent contradict each other."""
    if roots and parent_id is not None:
        raise ValueError("a run with a parent is no root")
    out = [] if roots is None else [is_root() if roots else ~is_root()]
    return all_of(*out, *([F.col("trace_id") == trace_id] if trace_id else []), *([F.col("parent_run_id") == parent_id] if parent_id else []))


def mentions_model(model: str, *columns: Column | str) -> Column:
    return json_text(*columns).contains(model)


def billable() -> Column:
    """LLM runs with a model: wrappers around them would count their tokens twice."""
    return (F.col("run_type") == "llm") & (F.col("model") != "unknown")


def path_within(path: Column | str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    c, include = _col(path), list(include)
    return all_of(*([any_of(*(c.startswith(p) for p in include))] if include else []), none_of(*(c.startswith(p) for p in exclude)))


@dataclass
class RunFilter:
    """All conditions on runs at once; only those that are set count."""

    status: str | None = None
    since: datetime | None = None
    before: datetime | None = None
    last: timedelta | None = None
    now: datetime | None = None
    min_latency: float | None = None
    max_latency: float | None = None
    tags: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    run_type: str | None = None
    exact: str | None = None
    regex: str | None = None
    glob: str | None = None
    contains: str | None = None
    exclude: tuple[str, ...] = ()
    roots: bool | None = None
    query: str | None = None

    def column(self) -> Column:
        out = []
        if self.status is not None:
            if self.status not in ("error", "success"):
                raise ValueError(f"no such status: {self.status!r}")
            out.append(failed() if self.status == "error" else succeeded())
        if self.since or self.before or self.last:
            out.append(time_window(since=self.since, before=self.before, last=self.last, now=self.now))
        if self.min_latency is not None or self.max_latency is not None:
            out.append(latency_between("latency_s", self.min_latency, self.max_latency))
        if self.tags:
            out.append(has_all_tags(self.tags))
        out += [metadata_like(k, v) if re.search(r"[*?\[]", v) else metadata_is(k, v) for k, v in self.metadata.items()]
        if self.run_type is not None:
            out.append(F.col("run_type") == self.run_type)
        if self.exact or self.regex or self.glob or self.contains:
            out.append(name_matches(exact=self.exact, regex=self.regex, glob=self.glob, contains=self.contains))
        if self.exclude:
            out.append(excludes(self.exclude))
        if self.roots is not None:
            out.append(root_scope(self.roots))
        if self.query is not None:
            out.append(search(self.query, "name", "error"))
        return all_of(*out)
