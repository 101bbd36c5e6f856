"""Column expressions over text: normalisation, predicates, cues and parsers. All run in the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions import patterns as P

UNICODE = "(?U)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, with Unicode word and space classes."""
    return text.rlike(UNICODE + pattern)


def removed(text: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(text, UNICODE + pattern, new)


def extracted(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


@functools.cache
def decompositions() -> tuple[str, str]:
    """Single characters whose compatibility decomposition, marks dropped, is one other character, and those."""
    pairs = []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Compatibility characters that decompose to several letters and do occur in running text.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "™": "TM", "…": "...", "№": "No", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4"}


def norm_key(text: Column) -> Column:
    """Lower case, no accents or punctuation but ``+ # .``, single spaces, ``#`` and ``+`` bound to the word before."""
    plain = text
    for sign, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(letters))
    plain = removed(F.translate(plain, *decompositions()), r"\p{M}+")
    # plain ASCII, the usual case, has nothing to decompose
    plain = F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text))
    plain = removed(removed(plain, r"\s+([#+])", "$1"), r"[^\w+#.]+", " ")
    return F.trim(removed(removed(plain, r"\s+", " "), r" ([#+])", "$1"))


def norm_key_of(text: str) -> str:
    """``norm_key`` of one Python string, for dictionaries."""
    import re

    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().strip()
    plain = re.sub(r"[^\w+#.]+", " ", re.sub(r"\s+([#+])", r"\1", plain))
    return re.sub(r" ([#+])", r"\1", " ".join(plain.split()))


def singulars(key: Column) -> list[Column]:
    """Singular spellings of a key, in order of preference; null where one does not apply."""
    return [
        F.when(key.endswith("ies") & (F.length(key) > 5), F.concat(key.substr(F.lit(1), F.length(key) - 3), F.lit("y"))),
        F.when(key.endswith("es") & (F.length(key) > 4), key.substr(F.lit(1), F.length(key) - 2)),
        F.when(key.endswith("s") & (F.length(key) > 3) & ~key.endswith("ss"), key.substr(F.lit(1), F.length(key) - 1)),
    ]


def collapsed(text: Column) -> Column:
    return F.trim(removed(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def stripped(text: Column, signs: str = "") -> Column:
    """Without white space, or any of ``signs`` (a character class body), at both ends."""
    body = signs or r"\s\x1c-\x1f"
    return removed(text, rf"^[{body}]+|[{body}]+$")


def content_tokens(text: Column) -> Column:
    """Distinct tokens of two or more signs that are not stop words."""
    return F.array_distinct(F.filter(F.split(norm_key(text), " "), lambda w: (F.length(w) > 1) & ~w.isin(P.STOPWORDS)))


def mask_contacts(text: Column) -> Column:
    """E-mail addresses, then URLs, then telephone numbers masked."""
    return removed(removed(removed(text, P.EMAIL, "[email]"), P.URL, "[url]"), P.PHONE, "[phone]")


def looks_like_posting(text: Column) -> Column:
    hits = F.lit(0)
    for sign in P.POSTING_SIGNALS:
        hits = hits + F.lower(text).contains(sign).cast("int")
    return hits >= 2


def is_bullet(line: Column) -> Column:
    return found(line, P.BULLET)


def section_heading(line: Column, bullet: Column) -> Column:
    """The section that a line opens, or null."""
    lowered, section = stripped(F.lower(line), " :#*"), F.lit(None).cast("string")
    for name, pattern in reversed(P.SECTIONS):
        section = F.when(found(lowered, pattern), name).otherwise(section)
    return F.when(~bullet & (F.length(line) <= 60) & ~found(line, P.EMAIL) & ~found(line, P.URL), section)


def is_heading(line: Column) -> Column:
    text = stripped(line)
    own = words(text)
    letters = F.filter(own, lambda w: found(w, r"^\p{L}+$"))
    marked = found(text, r"^[#*-]") & (F.size(own) <= 5)
    short = (F.size(own) > 0) & (F.size(own) <= 6) & (text.endswith(":") | F.forall(letters, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return F.when(marked, text.startswith("#")).otherwise(short)


def without_bullet(line: Column) -> Column:
    return removed(line, P.BULLET_MARK)


def clean_markdown(text: Column) -> Column:
    return stripped(removed(text, r"\s*\*+", " "))


def without_label(text: Column) -> Column:
    """A leading ``**Label:**`` dropped, and emphasis left over from it."""
    return stripped(removed(stripped(removed(text, P.LEADING_LABEL)), r"^\*+\s*"))


def is_prose(line: Column) -> Column:
    text = clean_markdown(without_label(line))
    return (F.size(words(text)) > 16) | found(text, P.PROSE) | (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) >= 2)


def asks_for_degree(text: Column) -> Column:
    return found(text, P.EDUCATION_REQUIREMENT)


def is_labelled(line: Column) -> Column:
    """A section label, or a short ``Label: list``."""
    text = stripped(without_bullet(line))
    tail = stripped(removed(text, r"^[^:]*:"))
    listed = found(text, P.LABELLED) & ~found(text, P.LABELLED_PROSE) & (F.length(tail) > 0) & (F.size(words(tail)) <= 12) & ~found(tail, P.LABEL_TAIL_PROSE)
    return found(text, P.SECTION_LABEL) | listed


def has_action_verb(text: Column) -> Column:
    return (F.length(text) >= 12) & found(text, P.ACTION_VERBS)


def requirement_phrase(text: Column) -> Column:
    """The first clause as a name, without trailing importance words; null if it is too short."""
    whole = stripped(without_bullet(text))
    clause = stripped(F.get(F.split(whole, UNICODE + r"(?<=[.!?])\s+|;\s+"), 0))
    short = F.when(F.size(words(clause)) > 22, F.array_join(F.slice(words(clause), 1, 22), " ")).otherwise(clause)
    name = F.substring(removed(short, r"[ .;:-]+$"), 1, 120)
    bare = removed(removed(name, P.TRAILING_IMPORTANCE), r"[ .;:-]+$")
    return F.when((F.length(whole) >= 12) & (F.length(clause) >= 12), F.coalesce(F.nullif(bare, F.lit("")), name))


def importance(text: Column, default: str = "preferred") -> Column:
    """Of all cues the weakest one counts."""
    lowered = F.lower(text)
    out = F.lit(default)
    for name in ("must", "preferred", "nice_to_have"):
        out = F.when(found(lowered, P.IMPORTANCE_HINTS[name]), name).otherwise(out)
    return out


def proficiency(text: Column) -> Column:
    lowered, out = F.lower(text), F.lit("working")
    for name, pattern in reversed(P.PROFICIENCY_CUES):
        out = F.when(found(lowered, pattern), name).otherwise(out)
    return out


def proficiency_score(name: Column) -> Column:
    out = F.lit(0.0)
    for value, score in P.PROFICIENCY_SCORES.items():
        out = F.when(name == value, score).otherwise(out)
    return out


def category(text: Column, section: Column) -> Column:
    out = F.lit("skill")
    for name, value in P.SECTION_CATEGORIES.items():
        out = F.when(section == name, value).otherwise(out)
    for name, pattern in reversed(P.CATEGORY_CUES):
        out = F.when(found(F.lower(text), pattern), name).otherwise(out)
    return out


def years(text: Column) -> Column:
    """Years that a phrase states: digits (none above 50), else a number word."""
    digits, word = extracted(text, P.YEARS, 1), F.lower(extracted(text, P.YEARS_IN_WORDS, 1))
    named = F.lit(None).cast("double")
    for value, name in enumerate(P.WORD_NUMBERS, 1):
        named = F.when(word == name, float(value)).otherwise(named)
    number = digits.cast("double")
    return F.when(digits.isNotNull(), F.when(number <= 50, number)).otherwise(named)


def degree_level(text: Column) -> Column:
    out = F.lit(0)
    for level, pattern in reversed(P.DEGREE_LEVELS):
        out = F.when(found(text, pattern), level).otherwise(out)
    return F.coalesce(out, F.lit(0))


def seniority(text: Column) -> Column:
    lowered, out = F.lower(text), F.lit("unknown")
    for level, signs in reversed(P.SENIORITY):
        hit = F.lit(False)
        for sign in signs:
            hit = hit | lowered.contains(sign)
        out = F.when(hit, level).otherwise(out)
    return out


def month_number(token: Column) -> Column:
    """The month of a name by its first four letters; December for a sign of going on."""
    key, out = removed(F.substring(F.lower(stripped(token)), 1, 4), r"\.+$"), F.lit(None).cast("int")
    for name, number in P.MONTHS.items():
        out = F.when(key == name, number).otherwise(out)
    return F.when(is_current(key), 12).otherwise(out)


def is_current(token: Column) -> Column:
    key = removed(F.lower(stripped(token)), r"\.+$")
    return key.isin(P.CURRENT) | key.startswith("present") | key.startswith("curr") | key.startswith("to ")


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0, so that two can be subtracted."""
    return year * 12 + month - 1


def date_ranges(text: Column, as_of: tuple[int, int]) -> Column:
    """array<struct<start, finish>> of the valid month ranges in a text; open ones end at ``as_of`` (year, month)."""
    valid = lambda y: y.between(1970, 2100)
    now_year, now_month = as_of

    def of(match: Column) -> Column:
        part = [F.nullif(F.regexp_extract(match, P.DATE_RANGE, k), F.lit("")) for k in range(9)]
        number = lambda k: part[k].cast("int")
        start_month = F.when(part[3].isNotNull(), number(3)).otherwise(month_number(part[1]))
        start_year = F.coalesce(number(4), number(2))
        going = part[7].isNull() & is_current(part[5])
        end_year = F.when(part[7].isNotNull(), number(8)).when(going, now_year).otherwise(F.coalesce(number(6), start_year))
        end_month = F.when(part[7].isNotNull(), number(7)).when(going, now_month).otherwise(month_number(part[5]))
        end_month = F.when(end_month.between(1, 12), end_month).otherwise(12)
        fine = start_month.between(1, 12) & valid(start_year) & valid(end_year)
        return F.when(fine, F.struct(month_index(start_year, start_month).alias("start"), month_index(end_year, end_month).alias("finish")))

    matches = F.regexp_extract_all(text, F.lit(P.DATE_RANGE), F.lit(0))
    return F.filter(F.transform(matches, of), lambda r: r.isNotNull() & (r["finish"] >= r["start"]))


def compound_parts(text: Column) -> Column:
    """Phrases between ``and``, ``or`` and commas, and around slashes that do not join words (``CI/CD`` stays whole)."""
    cut = F.split(text, UNICODE + r"(?i)\s+(?:and|or)\s+|,|(?<![A-Za-z0-9+#.])/|/(?![A-Za-z0-9+#.])")
    return F.filter(F.transform(cut, lambda p: stripped(p, " .;:\\-")), lambda p: F.length(p) > 0)


def json_object(raw: Column) -> Column:
    """The text from the first brace on; a JSON reader stops at the matching one."""
    at = F.locate("{", raw)
    return F.when(at > 0, F.substring(raw, at, F.length(raw)))


def cosine(left: Column, right: Column) -> Column:
    """Dot product of unit vectors, held within -1 and 1."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
