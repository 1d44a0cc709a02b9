"""Pages and documents: blocks, links, postings, tasks, missing rates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketloom.functions.text import block_key, col, document_metadata, id_from_url, text_or_empty

# Words of challenge pages, and headings that open and close a list of tasks.
CHALLENGE = ["just a moment", "verify you are human", "captcha"]
TASK_HEADINGS = [
    "responsibilities", "responsibility", "your daily tasks", "daily tasks", "what you will do", "what you'll do", "what you’ll do", "the role",
    "job description", "role description", "mô tả công việc", "nhiệm vụ", "trách nhiệm", "công việc của bạn",
]
STOP_HEADINGS = [
    "requirements", "qualifications", "your background", "what you need", "who you are", "skills", "experience", "benefits", "why join",
    "yêu cầu", "quyền lợi", "phúc lợi", "kinh nghiệm",
]
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li")


def is_challenge(page) -> Column:
    """F5. A page that asks whether its reader is human."""
    return F.coalesce(F.lower(col(page)).rlike("|".join(CHALLENGE)), F.lit(False))


class _Blocks(HTMLParser):
    def __init__(self, names: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.names, self.open, self.done, self.hidden, self.loose = names, [], [], 0, []

    def _close(self, tag: str) -> None:
        while self.open:
            name, parts, strong = self.open.pop()
            text = re.sub(r"\s+", " ", " ".join(parts)).strip()
            if text:
                self.done.append((name, text, strong))
            if name == tag:
                break

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.names:
            if any(o[0] in ("p", tag) for o in self.open):  # a block ends where its like begins
                self._close(tag if any(o[0] == tag for o in self.open) else "p")
            self.open.append((tag, [], False))
        elif tag in ("strong", "b") and self.open:
            name, parts, _ = self.open.pop()
            self.open.append((name, parts, True))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif any(o[0] == tag for o in self.open):
            self._close(tag)

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.loose.append(data)
            if self.open:
                self.open[-1][1].append(data.strip())


def page_blocks(page: str, names: tuple[str, ...] = BLOCKS) -> list[tuple[str, str, bool]]:
    """Tag, text and whether it holds bold type of each block in order; the whole text if there is no block."""
    parser = _Blocks(names)
    parser.feed(page)
    parser.close()
    while parser.open:
        parser._close("")
    text = re.sub(r"\s+", " ", " ".join(parser.loose)).strip()
    return parser.done or ([("text", text, False)] if text else [])


def html_blocks(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """P1. ``id, pos, tag, strong, block, key``: text blocks in order; of neighbours with the same key the first stays."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, tag, strong, text) for i, page in zip(batch["id"], batch["page"]) for k, (tag, text, strong) in enumerate(page_blocks(page or ""))]
            yield pd.DataFrame(rows, columns=["id", "pos", "tag", "strong", "block"])

    source = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("page"))
    blocks = source.mapInPandas(run, f"id {kind}, pos int, tag string, strong boolean, block string").withColumn("key", block_key("block"))
    before = F.lag("key").over(W.partitionBy("id").orderBy("pos"))
    return blocks.withColumn("_b", before).filter(~F.col("key").eqNullSafe(F.col("_b"))).drop("_b").withColumnRenamed("id", id_col)


def extract_links(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """P2. ``id, href, link_id``: the distinct link targets of each page."""
    hrefs = F.regexp_extract_all(text_or_empty(html_col), F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"'#]+)["']"""), F.lit(1))
    return df.select(id_col, F.explode(F.array_distinct(hrefs)).alias("href")).withColumn("link_id", id_from_url("href"))


# How a card's lines show pay, deadline, company and place, and lines that say nothing; points of a card.
SALARY_PATTERNS = [
    r"(?iu)(\d+(?:[.,]\d+)?\s*[-–—]\s*\d+(?:[.,]\d+)?\s*(?:triệu|tr)\b)",
    r"(?iu)((?:từ|đến|upto|up\s*to)\s*\d+(?:[.,]\d+)?\s*(?:triệu|tr)\b)",
    r"(?iu)((?:thỏa|thoả)\s*thuận)",
]
DATE_PATTERN = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
COMPANY_PATTERN = r"(?iU)\b(công ty|cty|tnhh|cổ phần|tập đoàn|company|corporation|ltd|jsc|group|doanh nghiệp|xí nghiệp)\b"
CARD_NOISE = ["gấp", "hot", "mới", "tin mới", "ưu tiên", "nổi bật", "ứng tuyển", "xem chi tiết", "lưu việc làm", "nộp đơn"]
LOCATION_HINTS = [
    "TPHCM", "TP.HCM", "Hồ Chí Minh", "Hà Nội", "Đà Nẵng", "Bình Dương", "Đồng Nai", "Bắc Ninh", "Hải Phòng", "Cần Thơ",
    "Long An", "Bà Rịa - Vũng Tàu", "Vũng Tàu", "Toàn quốc",
]
CARD_POINTS = {"salary": 5, "date": 4, "place": 3, "company": 2, "comma": 1}


def _any_pay(x: Column) -> Column:
    return x.rlike(SALARY_PATTERNS[0]) | x.rlike(SALARY_PATTERNS[1]) | x.rlike(SALARY_PATTERNS[2])


def _any_place(x: Column) -> Column:
    return F.lower(x).rlike("|".join(re.escape(h.lower()) for h in LOCATION_HINTS))


def score_card(text: Column) -> Column:
    """P3. Points of a card's text; null outside 40 to 3000 characters."""
    signs = {"salary": _any_pay(text), "date": text.rlike(DATE_PATTERN), "place": _any_place(text), "company": text.rlike(COMPANY_PATTERN), "comma": text.contains(",")}
    points = F.lit(0)
    for name, sign in signs.items():
        points = points + F.when(sign, CARD_POINTS[name]).otherwise(0)
    return F.when(F.length(text).between(40, 3000), points)


# Addresses of postings, and of category pages that look like them.
JOB_PATH = r"(?i)^/viec-lam/.+-\d+\.html$"
CATEGORY_PATH = "/viec-lam/danh-muc-"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def job_path(href: str, path: str = JOB_PATH, hosts: tuple[str, ...] = ()) -> str | None:
    """The path of a posting's address, without query and fragment; None for any other address.

    Absolute addresses count if their host is one of ``hosts``, or whatever it is if none are given.
    """
    m = re.match(r"(?:(?:https?:)?//([^/?#]+))?(/[^?#]*)", href.strip(), re.IGNORECASE)
    if not m or m[1] and hosts and m[1].lower() not in hosts:
        return None
    bare = m[2].rstrip("/")
    return bare if not bare.lower().startswith(CATEGORY_PATH) and re.match(path, bare) else None


class _Cards(HTMLParser):
    """The tree of a page's elements: the own text of each posting's link, and the texts of all elements around it.

    An element is a card of a posting if no other posting is linked within it; links that lead elsewhere, as to a company
    or from a logo, don't matter.
    """

    def __init__(self, path: str, hosts: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.path, self.hosts = path, hosts
        self.stack: list[tuple[str, list[str], set[str], str | None]] = []
        self.cards: list[tuple[str, str]] = []
        self.titles: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            href = next((v for k, v in attrs if k == "href" and v), None) if tag == "a" else None
            job = job_path(href, self.path, self.hosts) if href else None
            self.stack.append((tag, [], {job} if job else set(), job))

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] not in ("script", "style") and data.strip():
            self.stack[-1][1].append(re.sub(r"\s+", " ", data).strip())

    def handle_endtag(self, tag):
        if not any(s[0] == tag for s in self.stack):
            return
        while self.stack:
            name, parts, jobs, own = self.stack.pop()
            if own and parts:
                self.titles.setdefault(own, " ".join(parts))
            if len(jobs) == 1 and name not in ("body", "html"):
                text = "\n".join(parts)
                if len(text) <= 3000:
                    self.cards.append((*jobs, text))
            if self.stack:
                self.stack[-1][1].extend(parts)
                self.stack[-1][2].update(jobs)
            if name == tag:
                break


def _card_fields(lines: Column, title: Column) -> list[Column]:
    """Pay, deadline, place, company and skills from a card's lines; the title's own line tells nothing of them."""
    low = F.lower
    same = lambda x, *values: F.coalesce(low(x).isin(*[F.coalesce(low(v), F.lit("")) for v in values]), F.lit(False))
    noise = lambda x: low(x).isin(CARD_NOISE)
    first = lambda xs: F.get(xs, F.lit(0))
    dated = lambda x: x.rlike(DATE_PATTERN)
    others = F.filter(lines, lambda x: ~same(x, title))
    paid = first(F.filter(others, _any_pay))
    pay = F.coalesce(*(F.nullif(F.regexp_extract(paid, p, 1), F.lit("")) for p in SALARY_PATTERNS))
    deadline = F.nullif(F.regexp_extract(first(F.filter(lines, dated)), DATE_PATTERN, 0), F.lit(""))
    spots = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    place_of = lambda test: first(F.filter(spots, lambda s: ~same(s["x"], title) & test(s["x"])))["i"]
    a, b = place_of(_any_pay), place_of(dated)
    between = F.filter(F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))), lambda x: ~noise(x) & ~x.rlike(COMPANY_PATTERN) & F.length(x).between(2, 100))
    place = F.coalesce(first(F.filter(others, _any_place)), F.when(b > a + 1, first(between)))
    named = lambda p, d, w: F.filter(lines, lambda x: ~same(x, title, p, w, d) & ~noise(x) & ~dated(x) & ~_any_pay(x) & F.length(x).between(3, 240))
    company = lambda xs: F.coalesce(first(F.filter(xs, lambda x: x.rlike(COMPANY_PATTERN))), first(xs))
    return [pay, deadline, place, lambda p, d, w: company(named(p, d, w))]


def parse_listing(df: DataFrame, id_col: str, html_col: str, path: str = JOB_PATH, hosts: tuple[str, ...] = ()) -> DataFrame:
    """P3. One row for each posting linked from a listing page: its best card, cut into lines, and fields picked from them.

    A card is an element around a posting's link that holds no link to another posting. The best one has most points,
    then most characters. Links to postings are those whose path is like ``path`` (``job_path``); ``href`` is that path.
    ``job_title_raw`` is the link's own text. Pay comes from a line other than the title; place from a line that names
    one, else from the lines between pay and deadline; ``skills_raw`` from the lines after the deadline, at commas.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, page in zip(batch["id"], batch["page"]):
                parser = _Cards(path, hosts)
                parser.feed(page or "")
                rows += [(i, k, href, parser.titles.get(href), text) for k, (href, text) in enumerate(parser.cards)]
            yield pd.DataFrame(rows, columns=["id", "pos", "href", "title", "card"])

    source = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("page"))
    cards = source.mapInPandas(run, f"id {kind}, pos int, href string, title string, card string").withColumn("points", score_card(F.col("card")))
    best = cards.filter("points is not null").groupBy("id", "href").agg(F.max_by(F.struct("title", "card", "points"), F.struct("points", F.length("card"), -F.col("pos"))).alias("m"))
    every = F.filter(F.split("card", "\n"), lambda x: x != "")
    spots = F.transform(every, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    lines = F.transform(F.filter(spots, lambda s: F.array_position(F.transform(every, lambda y: F.lower(y)), s["k"]) == s["i"] + 1), lambda s: s["x"])
    cut = best.select(F.col("id").alias(id_col), "href", id_from_url("href").alias("source_job_id"), F.col("m.title").alias("job_title_raw"), F.col("m.card").alias("card"), F.col("m.points").alias("points"))
    cut = cut.withColumn("_lines", lines)
    pay, deadline, place, company = _card_fields(F.col("_lines"), F.col("job_title_raw"))
    cut = cut.withColumns({"salary_raw": pay, "deadline_raw": deadline, "location_raw": place})
    cut = cut.withColumn("company_name_raw", company(F.col("salary_raw"), F.col("deadline_raw"), F.col("location_raw")))
    known = [F.coalesce(F.lower(c), F.lit("")) for c in ("job_title_raw", "company_name_raw", "salary_raw", "location_raw", "deadline_raw")]
    dated = F.get(F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(DATE_PATTERN)), F.lit(0))["i"]
    after = F.slice("_lines", F.coalesce(dated + 2, F.lit(1)), F.size("_lines"))
    told = F.filter(after, lambda x: ~F.lower(x).isin(*known))
    parts = F.flatten(F.transform(told, lambda x: F.when(x.contains(","), F.split(F.replace(x, F.lit("...")), ",")).otherwise(F.array(x))))
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: F.length(x).between(2, 80) & ~F.lower(x).isin(CARD_NOISE))
    keys = lambda xs: F.transform(xs, lambda y: F.lower(y))
    once = F.filter(clean, lambda x, i: F.array_position(keys(clean), F.lower(x)) == i + 1)
    return cut.withColumn("skills_raw", F.to_json(once)).drop("_lines")


JSONLD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def find_posting(value):
    """The first object of type ``JobPosting`` in parsed JSON, itself first, then what it holds, in order."""
    if isinstance(value, list):
        return next((found for x in value if (found := find_posting(x))), None)
    if not isinstance(value, dict):
        return None
    kind = value.get("@type")
    if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
        return value
    return find_posting(list(value.values()))


@F.pandas_udf(StringType())
def _embedded(scripts: pd.Series) -> pd.Series:
    def first(texts) -> str | None:
        for text in texts if texts is not None else ():
            try:
                found = find_posting(json.loads(text))
            except (json.JSONDecodeError, RecursionError):
                continue
            if found:
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        return None

    return scripts.map(first)


def extract_jsonld(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """P4. The embedded posting of each page as JSON, and its title; else the page's own title.

    Postings are found wherever they lie in a script's JSON, also where ``@type`` is a list; scripts that are no JSON are
    passed over. ``parser_method`` says what was used. Pages without such a script never reach Python.
    """
    scripts = F.regexp_extract_all(text_or_empty(html_col), F.lit(JSONLD), F.lit(1))
    found = df.select(id_col, F.col(html_col).alias("_page"), scripts.alias("_scripts"))
    none = F.lit(None).cast("string")
    some = found.filter(F.size("_scripts") > 0).withColumn("posting", _embedded("_scripts"))
    both = some.unionByName(found.filter(F.size("_scripts") == 0).withColumn("posting", none))
    title = F.nullif(F.trim(F.regexp_extract(text_or_empty("_page"), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return both.select(
        id_col,
        "posting",
        F.coalesce(F.get_json_object("posting", "$.title"), title).alias("title"),
        F.get_json_object("posting", "$.description").alias("description"),
        F.when(F.col("posting").isNotNull(), "json_ld").when(title.isNotNull(), "page_title").otherwise("none").alias("parser_method"),
    )


def typical_tasks(blocks: DataFrame, id_col: str, limit: int = 8) -> DataFrame:
    """P5. ``id, rank, task``: list items of 12 to 350 characters below a heading of tasks, until one that ends them.

    ``blocks`` come from ``html_blocks``. Items equal in letters and digits count once; the first ``limit`` stay.
    """
    low = F.lower("block")
    heading = F.col("tag").isin(*HEADINGS) | ((F.col("tag") == "p") & F.col("strong"))
    has = lambda words: low.rlike("|".join(map(re.escape, words)))
    sign = F.when(heading & has(TASK_HEADINGS), True).when(heading & has(STOP_HEADINGS), False)
    order = W.partitionBy(id_col).orderBy("pos")
    section = blocks.withColumn("_on", F.last(sign, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    task = F.btrim("block", F.lit(" •-–—\t"))
    items = section.filter((F.col("tag") == "li") & F.col("_on")).select(id_col, "pos", task.alias("task")).filter(F.length("task").between(12, 350))
    once = items.withColumn("_key", F.regexp_replace(F.lower("task"), "[^a-z0-9]+", "")).groupBy(id_col, "_key").agg(F.min(F.struct("pos", "task")).alias("m"))
    ranked = once.select(id_col, "m.*").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit).select(id_col, "rank", "task")


def extract_documents(df: DataFrame, id_col: str, content_col: str, name_col: str) -> DataFrame:
    """P6. Status of each file of ``binaryFile`` rows: text and metadata, or why it failed. Plain text files only."""
    text = F.try_validate_utf8(F.col(content_col).cast("string"))
    why = F.when(~F.lower(name_col).endswith(".txt"), "unsupported type").when(text.isNull(), "not UTF-8").when(F.trim(text) == "", "empty document")
    good = df.select(id_col, text.alias("text"), why.alias("error"))
    meta = document_metadata("text")
    return good.select(id_col, F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error", *(F.when(F.col("error").isNull(), c).alias(k) for k, c in meta.items()))


def missing_rates(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """P7. One row: rows, repeated ids and the share of nulls in each column."""
    return df.agg(
        F.count("*").alias("row_count"),
        (F.count(id_col) - F.count_distinct(id_col)).alias("duplicate_ids"),
        *(F.round(F.avg(F.col(c).isNull().cast("int")), 4).alias(f"missing_{c}") for c in columns),
    )


