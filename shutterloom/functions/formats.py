"""Display strings and path helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(x: Column, digits: int) -> Column:
    """Rounded as the double is, ties to even; format_string rounds its shortest decimals, ties up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def shutter(seconds: Column) -> Column:
    """1.5s from one second on, else 1/250s; null for what is not positive."""
    slow = F.concat(_fixed(seconds, 1), F.lit("s"))
    fast = F.concat(F.lit("1/"), F.floor(1 / seconds + 0.5).cast("string"), F.lit("s"))
    return F.when(seconds > 0, F.when(seconds >= 1, slow).otherwise(fast))


def exposure_bias(ev: Column) -> Column:
    sign = F.when(ev > 0, F.lit("+")).otherwise(F.lit("-"))
    return F.when(F.abs(ev) < 0.05, F.lit("±0 EV")).when(ev.isNotNull(), F.concat(sign, _fixed(F.abs(ev), 1), F.lit(" EV")))


def exposure_bias_short(ev: Column) -> Column:
    """Without the unit, for rows that are labelled EV already."""
    return F.regexp_replace(exposure_bias(ev), " EV$", "")


def _plain(x: Column) -> Column:
    """A number as it is, whole ones without a fraction."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def aperture(f: Column) -> Column:
    return F.concat(F.lit("ƒ/"), _plain(f))


def iso(value: Column) -> Column:
    return value.cast("string")


def focal(mm: Column) -> Column:
    return F.concat(F.floor(mm + 0.5).cast("string"), F.lit(" mm"))


def white_balance(mode: Column) -> Column:
    return F.when(mode == 0, F.lit("AWB")).when(mode == 1, F.lit("WB manual"))


def dimensions(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit(" × "), height.cast("string")))


def file_size(size: Column) -> Column:
    return F.when(size > 0, F.concat(_fixed(size / 1048576.0, 1), F.lit(" MB")))


def image_size(width: Column, height: Column, size: Column) -> Column:
    return F.nullif(F.concat_ws(", ", dimensions(width, height), file_size(size)), F.lit(""))


def time_of_day(text: Column) -> Column:
    """HH:mm:ss of an ISO time; null if it does not parse."""
    return F.date_format(F.try_to_timestamp(text), "HH:mm:ss")


def relative_time(then: Column, now: Column) -> Column:
    """Both in epoch milliseconds; a time still to come is just now."""
    s = F.floor((now - then) / 1000 + 0.5)
    minutes, hours, days, weeks = (F.floor(s / unit) for unit in (60, 3600, 86400, 604800))
    ago = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word} ago").otherwise(f" {word}s ago"))
    return (
        F.when(s < 60, F.lit("just now")).when(minutes < 60, ago(minutes, "minute")).when(hours < 24, ago(hours, "hour")).when(days < 2, F.lit("yesterday")).when(days < 7, ago(days, "day"))
        .when(weeks == 1, F.lit("last week")).when(weeks < 5, ago(weeks, "week")).otherwise(F.date_format(F.timestamp_millis(then.cast("bigint")), "MMM d, yyyy"))
    )


def basename(path: Column) -> Column:
    """What follows the last separator; the whole path where nothing does."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/\\]*)$", 1), F.lit("")), path)


def strip_ext(name: Column) -> Column:
    """Without what follows the last dot."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def join_path(folder: Column, name: Column) -> Column:
    """With the folder's own separator."""
    sep = F.when(folder.contains("\\"), F.lit("\\")).otherwise(F.lit("/"))
    return F.concat(F.regexp_replace(folder, r"[/\\]+$", ""), sep, name)


def sanitised_folder(name: Column) -> Column:
    """Without illegal characters, then cut to 32, then without spaces in front, then without dots and spaces at the end."""
    legal = F.regexp_replace(name, r'[<>:"/\\|?*]', "")
    return F.regexp_replace(F.regexp_replace(F.substring(legal, 1, 32), "^ +", ""), "[. ]+$", "")


def is_reserved_folder(name: Column) -> Column:
    base = F.element_at(F.split(name, r"\."), 1)
    return F.trim(base).rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")


def rejected_folder(name: Column) -> Column:
    clean = sanitised_folder(F.coalesce(name, F.lit("")))
    return F.when((clean == "") | is_reserved_folder(clean), F.lit("_rejected")).otherwise(clean)


def _shortened(text: Column, most: Column) -> Column:
    """An ellipsis in the middle of what is longer than ``most``."""
    head = F.ceil((most - 1) / 2).cast("int")
    tail = most - 1 - head
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit("…"), F.substring(text, F.length(text) - tail + 1, tail))
    return F.when(most <= 1, F.substring(text, 1, 1)).when(F.length(text) <= most, text).otherwise(cut)


def middle_truncated(text: Column, most: int) -> Column:
    return _shortened(text, F.lit(most))


def tail_path(path: Column, most: int) -> Column:
    """The end of a long path, from a separator on if there is one before its last character."""
    tail = F.substring(path, -(most - 1), most - 1)
    at = F.regexp_extract(tail, r"[/\\].+$", 0)
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit("…"), F.when(at != "", at).otherwise(tail)))


def folder_set(paths: Column, most: int = 52) -> Column:
    """The folders' names, as many as fit, then how many more; the first always shows, shortened if it must be."""
    names = F.transform(paths, basename)
    count = F.size(names)
    suffix = lambda left: F.when(left > 0, F.concat(F.lit(" +"), left.cast("string"), F.lit(" more"))).otherwise(F.lit(""))

    def fit(state: Column, name: Column) -> Column:
        text, left = F.concat(state["text"], F.lit(" + "), name), count - state["n"] - 1
        ok = state["open"] & (F.length(text) + F.length(suffix(left)) <= most)
        return F.struct(F.when(ok, text).otherwise(state["text"]).alias("text"), (state["n"] + ok.cast("int")).alias("n"), ok.alias("open"))

    start = F.struct(F.get(names, F.lit(0)).alias("text"), F.lit(1).alias("n"), F.lit(True).alias("open"))
    shown = F.aggregate(F.slice(names, 2, F.greatest(count - 1, F.lit(0))), start, fit)
    more = suffix(count - shown["n"])
    first = F.when((shown["n"] == 1) & (F.length(shown["text"]) + F.length(more) > most), _shortened(shown["text"], F.greatest(F.lit(1), F.lit(most) - F.length(more)))).otherwise(shown["text"])
    return F.when(count == 0, F.lit("")).otherwise(F.concat(first, more))


def suggestion_title(verdict: Column, confidence: Column, reasons: Column) -> Column:
    word = F.when(verdict.isin("reject", "favorite"), verdict).otherwise(F.lit("keep"))
    percent = F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws(" · ", F.concat(F.lit("suggested "), word), percent, F.nullif(F.array_join(reasons, ", "), F.lit("")))
