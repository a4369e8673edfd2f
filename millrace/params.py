"""Date parameters in specs, resolved once per run, and date-range reads."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from millrace import messages
from millrace.errors import TemplateError
from millrace.spec import PipelineSpec

# The parameters, their default formats, and the spec fields that
# never depend on the run date.
DEFAULT_FORMATS = {
    "today": "%Y-%m-%d",
    "yesterday": "%Y-%m-%d",
    "now": "%Y-%m-%dT%H:%M:%S",
}
UNRESOLVED_FIELDS = {
    "name",
    "description",
    "timezone",
    "run_as",
    "alerts",
    "checkpointing",
    "threads",
    "memory_limit",
    "target_file_size",
    "row_group_size",
}

_PARAMETER = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
_DATE_DIRECTIVES = {"%Y": r"(?P<y>\d{4})", "%m": r"(?P<m>\d{2})", "%d": r"(?P<d>\d{2})"}


def resolve(spec: PipelineSpec | dict, now: datetime | None = None) -> PipelineSpec:
    """A copy of the spec with every date parameter replaced by its text."""
    spec = PipelineSpec.load(spec)
    moment = now or datetime.now(timezone.utc)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    local = moment.astimezone(ZoneInfo(spec.timezone))

    def walk(value, where):
        if isinstance(value, str):
            return render(value, local, where)
        if isinstance(value, list):
            return [walk(item, f"{where}[{i}]") for i, item in enumerate(value)]
        if isinstance(value, dict):
            return {key: walk(item, f"{where}.{key}") for key, item in value.items()}
        return value

    return PipelineSpec.load({
        key: value if key in UNRESOLVED_FIELDS else walk(value, key)
        for key, value in spec.as_dict().items()
    })


def render(text: str, moment: datetime, where: str = "value") -> str:
    """Replace the date parameters of one string."""
    outside = _PARAMETER.sub("\0", text)
    if "}}" in outside:
        raise TemplateError(messages.STRAY_CLOSING.format(where=where, text=text))
    if "{{" in outside:
        raise TemplateError(messages.UNCLOSED.format(where=where, text=text))

    def value(match):
        name, pattern = _split(match[1], where)
        day = moment - timedelta(days=1) if name == "yesterday" else moment
        try:
            return day.strftime(pattern)
        except (TypeError, ValueError) as exc:
            raise TemplateError(
                messages.BAD_FORMAT.format(where=where, name=name, pattern=pattern)
            ) from exc

    return _PARAMETER.sub(value, text)


def _split(token: str, where: str) -> tuple[str, str]:
    if not token or "{{" in token:
        raise TemplateError(messages.BAD_TEMPLATE.format(where=where, token="{{" + token + "}}"))
    name, colon, pattern = token.partition(":")
    if name not in DEFAULT_FORMATS:
        raise TemplateError(messages.UNKNOWN_VARIABLE.format(where=where, name=name))
    if colon and not pattern:
        raise TemplateError(messages.EMPTY_FORMAT.format(where=where, name=name))
    return name, pattern or DEFAULT_FORMATS[name]


def dates_between(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def dated_paths(template: str, first: date, last: date) -> list[str]:
    """One path per day of the range, in order, without repeats."""
    paths = [
        render(template, datetime(d.year, d.month, d.day, tzinfo=timezone.utc))
        for d in dates_between(first, last)
    ]
    return list(dict.fromkeys(paths))


def run_date_pattern(template: str) -> tuple[str, int]:
    """A regex with groups y, m, d that finds the run date in a file path, and the
    number of days to add to what it finds (one for ``yesterday``)."""
    for match in _PARAMETER.finditer(template):
        name, pattern = _split(match[1], "path")
        body = re.escape(pattern).replace(r"\%", "%")
        for directive, group in _DATE_DIRECTIVES.items():
            body = body.replace(directive, group, 1)
        if all(f"(?P<{g}>" in body for g in "ymd") and "%" not in body:
            before = _literal_tail(template[: match.start()])
            after = _literal_head(template[match.end():])
            return before + body + after, int(name == "yesterday")
    raise TemplateError(
        f"path: {template!r} needs a date parameter made of %Y, %m and %d to tell run dates apart"
    )


def _literal_tail(text: str) -> str:
    return re.escape(re.split(r"[*?\[\]{}]|\}\}", text)[-1].rpartition("/")[2])


def _literal_head(text: str) -> str:
    return re.escape(re.split(r"[*?\[\]{}/]", text)[0])
