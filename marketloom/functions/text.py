"""Text, hash and URL functions: column in, column out. Only HTML needs Python (batches through Arrow)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
# Words of company forms.
COMPANY_FORMS = ["công ty", "cty", "tnhh", "cổ phần", "cp", "jsc", "ltd", "limited"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


class _Visible(HTMLParser):
    """Character data outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(value: str, between: str) -> str:
    parser = _Visible()
    parser.feed(html.unescape(value))
    parser.close()
    return unicodedata.normalize("NFC", between.join(parser.parts))


#: Rows that are Python objects at a time: a batch may hold thousands of whole pages.
SLICE_ROWS = 64


def by_slices(values: pa.Array, between: str) -> pa.Array:
    """``visible_text`` of every value."""
    done = [pa.array([], pa.string())]
    for k in range(0, len(values), SLICE_ROWS):
        done.append(pa.array([None if v is None else visible_text(v, between) for v in values.slice(k, SLICE_ROWS).to_pylist()], pa.string()))
    return pa.concat_arrays(done)


def _stripped(between: str):
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield by_slices(values, between)

    return run


def _without_markup(c: Column, between: str) -> Column:
    """Markup and entities removed. Rows without any, in ASCII, pass by the UDF as nulls and keep their text."""
    needs = c.rlike(r"[<&]|[^\x00-\x7F]")
    return F.coalesce(_stripped(between)(F.when(needs, c)), c)


def plain_text(c: str | Column) -> Column:
    """White space collapsed and trimmed, zero-width spaces as spaces; for text known to hold no markup."""
    spaced = F.replace(text_or_empty(c), F.lit("​"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, SPACE, " "))


def clean_text(c: str | Column) -> Column:
    """T1. Entities, tags, normal form C, zero-width spaces, white space. Null gives ''."""
    return plain_text(_without_markup(text_or_empty(c), " "))


def match_text(c: str | Column, markup: bool = True) -> Column:
    """T2. Clean text in lower case."""
    return F.lower(clean_text(c) if markup else plain_text(c))


def normalize_company(c: str | Column, markup: bool = True) -> Column:
    """T3. Company name without the words of its legal form."""
    forms = "|".join(COMPANY_FORMS)
    return F.trim(F.regexp_replace(F.regexp_replace(match_text(c, markup), rf"(?U)\b({forms})\b", " "), SPACE, " "))


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without; đ has no mark and stays."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(c) == 1 and len(base) == 1 and base != c:
            pairs.append((c, base))
    unique = dict(pairs)
    return "".join(unique), "".join(unique.values())


def fold_accents(c: str | Column) -> Column:
    """T4. Lower case without accents."""
    marks = r"[̀-ͯ]"
    return F.regexp_replace(F.translate(F.lower(text_or_empty(c)), *_accents()), marks, "")


def slug(c: str | Column) -> Column:
    """T5. Folded text, đ as d, all else as single underscores."""
    return F.btrim(F.regexp_replace(F.translate(fold_accents(c), "đ", "d"), "[^a-z0-9]+", "_"), F.lit("_"))


def prefixed_token(prefix: str, c: str | Column) -> Column:
    """T5. ``PREFIX_TOKEN`` from any text; null if nothing is left."""
    token = F.upper(slug(c))
    return F.when(token != "", F.concat(F.lit(f"{prefix}_"), token))


def block_key(c: str | Column) -> Column:
    """T6. Key of a text block: lower case, straight quotes, plain dashes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text_or_empty(c)), "“”‘’–—", "\"\"''--"), SPACE, " "))


def squeezed_or_null(c: str | Column) -> Column:
    """T7. White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(col(c), SPACE, " ")), F.lit(""))


def extraction_text(c: str | Column, markup: bool = True) -> Column:
    """T8. Like T1, but lines stay: tags become line ends and spaces collapse within lines."""
    bare = _without_markup(text_or_empty(c), "\n") if markup else text_or_empty(c)
    # fixed values: white space within and around lines
    spaced = F.regexp_replace(F.replace(bare, F.lit("​"), F.lit(" ")), r"(?U)[^\S\r\n]+", " ")
    return F.btrim(F.regexp_replace(spaced, r"(?U)\s*\n\s*", "\n"), F.lit(" \n\r\t"))


def clean_title(c: str | Column, markup: bool = True) -> Column:
    """T9. The role in a posting's title, without tags in brackets, calls, head counts and pay."""
    title = match_text(c, markup)
    # fixed values: what is taken out of a title, in this order
    for pattern, by in (
        (r"^\s*\[[^\]]+\]\s*", ""),
        (r"(?U)^(?:(?:gấp|tuyển dụng|tuyển|cần)\s+)+", ""),
        (r"(?U)^\d+\s+bạn\s+", ""),
        (r"\([^)]*(?:lương|salary|gross)[^)]*\)", " "),
        (r"(?U)(?:[-–—~]\s*)?\d+(?:[.,]\d+)?\s*[-–—]\s*\d+(?:[.,]\d+)?\s*(?:m|triệu)(?:\s+gross)?(?:\s*-.*)?$", " "),
        (SPACE, " "),
    ):
        title = F.regexp_replace(title, pattern, by)
    return F.btrim(title, F.lit(" -–—"))


def distinct_lines(c: str | Column) -> Column:
    """T10. Lines in order, each once, however its letters are cased; blank lines go."""
    lines = F.transform(F.split(text_or_empty(c), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x != "")
    pairs = F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    ordered = F.sort_array(pairs)
    first = F.filter(ordered, lambda s, j: (j == 0) | (F.get(ordered, j - 1)["k"] != s["k"]))
    back = F.sort_array(F.transform(first, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return F.array_join(F.transform(back, lambda s: s["x"]), "\n")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+84|0)[0-9]{9,10}"


def document_metadata(c: str | Column, preview_lines: int = 20) -> dict[str, Column]:
    """T11. Sorted distinct e-mails and phones, counts of non-blank lines and characters, first lines."""
    text = text_or_empty(c)
    # not F.trim itself: transform would hand it the line's number as the characters to trim
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = lambda p: F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), ",")
    return {
        "emails": found(EMAIL),
        "phones": found(PHONE),
        "line_count": F.size(lines).cast("long"),
        "character_count": F.length(text).cast("long"),
        "preview": F.array_join(F.slice(lines, 1, preview_lines), "\n"),
    }


def canonical_job_url(c: str | Column, base: str, hosts: list[str] | str, category: str = "/danh-muc-", path: str = r"^/viec-lam/[^?#]*-\d+\.html$") -> Column:
    """U1. Absolute address of a posting on an allowed host, without query and fragment; else null.

    ``hosts`` is a list, or a pattern that an allowed host (in lower case) matches somewhere.
    """
    raw = F.trim(text_or_empty(c))
    full = F.when(raw.rlike("^https?://"), raw).when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(
        F.concat(F.lit(base.rstrip("/")), F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), raw)))
    )
    bare = F.regexp_replace(full, r"[?#].*$", "")
    host, where = F.lower(F.regexp_extract(bare, r"^https?://([^/]+)", 1)), F.regexp_extract(bare, r"^https?://[^/]+(/.*)$", 1)
    good = (host.rlike(hosts) if isinstance(hosts, str) else host.isin(hosts)) & ~F.lower(where).contains(category) & where.rlike(path)
    return F.when((raw != "") & good, F.concat(F.lit("https://"), host, where))


def id_from_url(c: str | Column) -> Column:
    """U2. The number of a posting's page, or the start of the address's hash."""
    url = text_or_empty(c)
    number = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(number(r"/(\d+)\.html$"), number(r"-j(\d+)\.html$"), F.substring(F.sha2(url.cast("binary"), 256), 1, 16))


def _sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def content_hash(title, company, location, description, markup: bool = True) -> Column:
    """H1. Hash of what a posting says."""
    parts = [match_text(title, markup), normalize_company(company, markup), match_text(location, markup), match_text(description, markup)]
    return _sha256(F.concat_ws("|", *parts))


def _first_truthy(*columns) -> Column:
    return F.coalesce(*(F.nullif(col(c).cast("string"), F.lit("")) for c in columns))


def job_id(source, source_job_id, source_url, hash_) -> Column:
    """H2."""
    seed = F.concat(text_or_empty(source), F.lit("|"), F.coalesce(_first_truthy(source_job_id, source_url, hash_), F.lit("")))
    return F.concat(F.lit("job_"), F.substring(F.sha1(seed.cast("binary")), 1, 16))


def dedup_group_id(hash_) -> Column:
    """H3."""
    return F.concat(F.lit("dup_"), F.substring(col(hash_), 1, 16))


def cross_source_key(company, title, province, markup: bool = True) -> Column:
    """H4. Company, title and province, if all three are known."""
    parts = [normalize_company(company, markup), match_text(title, markup), match_text(province, markup)]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws("|", *parts))


def stable_id(prefix: str, *parts) -> Column:
    """H5. ``prefix_`` and the hash of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(_sha256(F.concat_ws("|", *(text_or_empty(p) for p in parts))), 1, 16))


def record_hash(names: list[str]) -> Column:
    """H6. Hash of a record as JSON with sorted keys; nulls are kept."""
    return _sha256(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}))
