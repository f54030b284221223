"""Ratings in XMP sidecars: reading as column expressions, writing as small string edits.

A sidecar may be ours or another program's, and stars may be the user's. ``Marks`` says how ours are told: our
namespace prefix and the creator tools that we go by. A favourite without a user's star gets one star, marked as ours;
one that has stars keeps them and is marked as a flag only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    prefix: str = "loom"
    namespace: str = "http://ns.shutterloom.example/1.0/"
    creators: tuple[str, ...] = ("Shutterloom",)

    @property
    def favourite(self) -> str:
        return f"{self.prefix}:fav"


_INT = r"^\s*([+-]?[0-9]{1,9})\s*$"
#: The namespace of the pick flag, and what says that a sidecar has user content.
_DM = "http://ns.adobe.com/xmp/1.0/DynamicMedia/"
USER_MARKS = ("xmp:Label", "dc:", "lr:", "crs:", "photoshop:", "tiff:", "exif:", "aux:", "xmpMM:")


def _integer(text: Column) -> Column:
    return F.when(text.rlike(_INT), F.trim(text).cast("int"))


def attribute(xmp: Column, name: str) -> Column:
    """The first name="..." as an integer; null if absent or no integer."""
    found = F.regexp_extract(xmp, re.escape(name) + r'="([^"]*)"', 1)
    return F.when(xmp.contains(f'{name}="'), _integer(found))


def star(xmp: Column) -> Column:
    """The rating: the element's, even where it is no number, else the attribute's."""
    element = r"<xmp:Rating>([\s\S]*?)</xmp:Rating>"
    return F.when(xmp.rlike(element), _integer(F.regexp_extract(xmp, element, 1))).otherwise(attribute(xmp, "xmp:Rating"))


def favourite_mark(xmp: Column, marks: Marks = Marks()) -> Column:
    needle = f'{marks.favourite}="'
    return F.when(xmp.contains(needle), F.regexp_extract(xmp, re.escape(needle) + r'([^"]*)"', 1))


def is_ours(xmp: Column, marks: Marks = Marks()) -> Column:
    found = xmp.contains(f"xmlns:{marks.prefix}=")
    for c in marks.creators:
        found = found | xmp.contains(f'CreatorTool="{c}') | xmp.contains(f'x:xmptk="{c}')
    return found


def rating(xmp: Column, marks: Marks = Marks()) -> Column:
    """keep, reject, favorite or null. The pick flag goes first; without it our older sidecars used stars -1, 0 and 5."""
    pick, stars = attribute(xmp, "xmpDM:pick"), star(xmp)
    liked = favourite_mark(xmp, marks).isNotNull() | F.coalesce(stars == 1, F.lit(False))
    old = F.when(stars == -1, "reject").when(stars == 5, "favorite").when(stars == 0, "keep")
    return F.when(pick < 0, "reject").when(pick > 0, F.when(liked, "favorite").otherwise("keep")).when(pick.isNull() & is_ours(xmp, marks), old)


def owns_star(xmp: Column, marks: Marks = Marks()) -> Column:
    """Whether the single star is our favourite's and may go with it."""
    mark = favourite_mark(xmp, marks)
    return F.when(mark.isNotNull(), mark == "star").otherwise(is_ours(xmp, marks) & F.coalesce(star(xmp) == 1, F.lit(False)))


def user_star(xmp: Column, marks: Marks = Marks()) -> Column:
    """1 to 5 as the user gave it; null for ours."""
    return F.when(~owns_star(xmp, marks) & star(xmp).between(1, 5), star(xmp))


# The writer's half works on one sidecar's string at a time, where the file is written.


def _read_star(xmp: str) -> int | None:
    if m := re.search(r"<xmp:Rating>([\s\S]*?)</xmp:Rating>", xmp):
        return int(m[1]) if re.match(_INT, m[1]) else None
    m = re.search(r'xmp:Rating="([^"]*)"', xmp)
    return int(m[1]) if m and re.match(_INT, m[1]) else None


def _mark(xmp: str, marks: Marks) -> str | None:
    m = re.search(re.escape(marks.favourite) + r'="([^"]*)"', xmp)
    return m[1] if m else None


def _ours(xmp: str, marks: Marks) -> bool:
    return f"xmlns:{marks.prefix}=" in xmp or any(f'CreatorTool="{c}' in xmp or f'x:xmptk="{c}' in xmp for c in marks.creators)


def _owns(xmp: str, marks: Marks) -> bool:
    mark = _mark(xmp, marks)
    return mark == "star" if mark is not None else _ours(xmp, marks) and _read_star(xmp) == 1


def _declared(xmp: str, name: str, value: str) -> str:
    """xmp with an attribute added after rdf:about, or where that is missing, after the description's name."""
    return re.sub(r'(<rdf:Description(?:\s+rdf:about="[^"]*")?)', lambda m: f'{m[1]}\n    {name}="{value}"', xmp, count=1)


def _with(xmp: str, name: str, value: str) -> str:
    made, n = re.subn(re.escape(name) + r'="[^"]*"', f'{name}="{value}"', xmp, count=1)
    return made if n else _declared(xmp, name, value)


def _without(xmp: str, name: str) -> str:
    return re.sub(r"\s*" + re.escape(name) + r'="[^"]*"', "", xmp, count=1)


def _starred(xmp: str, value: int) -> str:
    made, n = re.subn(r"<xmp:Rating>[\s\S]*?</xmp:Rating>", f"<xmp:Rating>{value}</xmp:Rating>", xmp, count=1)
    return made if n else _with(xmp, "xmp:Rating", str(value))


def _unstarred(xmp: str) -> str:
    made, n = re.subn(r"\s*<xmp:Rating>\s*1\s*</xmp:Rating>", "", xmp, count=1)
    return made if n else re.sub(r'\s*xmp:Rating="\s*1\s*"', "", xmp, count=1)


def fresh(marks: Marks = Marks()) -> str:
    return (
        f'<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{marks.creators[0]}">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
        f'  <rdf:Description rdf:about=""\n    xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n    xmp:CreatorTool="{marks.creators[0]}">\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n'
    )


def rated(xmp: str | None, value: str, marks: Marks = Marks()) -> str:
    """The sidecar with that rating; all else stays. Doing it twice changes nothing more."""
    pick, good = {"keep": ("1", "true"), "reject": ("-1", "false"), "favorite": ("1", "true")}[value]
    out = xmp or fresh(marks)
    if "xmlns:xmpDM=" not in out:
        out = _declared(out, "xmlns:xmpDM", _DM)
    out = _with(_with(out, "xmpDM:pick", pick), "xmpDM:good", good)
    if value == "favorite":
        own = _mark(out, marks) == "star"
        if f"xmlns:{marks.prefix}=" not in out:
            out = _declared(out, f"xmlns:{marks.prefix}", marks.namespace)
        if own or _read_star(out) in (None, 0):
            return _with(_starred(out, 1), marks.favourite, "star")
        return _with(out, marks.favourite, "flag")
    owned = _owns(out, marks)
    out = _without(out, marks.favourite)
    return _unstarred(out) if owned else out


def cleared(xmp: str, marks: Marks = Marks()) -> str | None:
    """The sidecar without our fields; None if it was ours and holds nothing of the user's, so that it can go."""
    owned = _owns(xmp, marks)
    out = xmp
    for name in ("xmpDM:pick", "xmpDM:good", marks.favourite):
        out = _without(out, name)
    out = _unstarred(out) if owned else out
    user = any(m in out for m in USER_MARKS) or (_read_star(out) or 0) in range(1, 6)
    return None if _ours(xmp, marks) and not user else out
