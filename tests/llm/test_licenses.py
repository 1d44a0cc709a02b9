import random
import re
import time

from pyspark.sql import functions as F

from marketloom.llm.licenses import CHARACTERS_AN_ERROR, NOTICES, PHRASES, _compiled, find_licenses, scan_licenses
from marketloom.llm.queries import op10_license_scans
from tests.llm.helpers import ODD_TEXTS, empty_docs, odd_docs

COMPILED = _compiled(tuple(NOTICES.items()), CHARACTERS_AN_ERROR)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(found), " ".join(words)


def least_edits(pattern, text):
    """Edits between ``pattern`` and the best prefix of ``text``."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(plain):
    """Notice, edits and place of the key of every match, without seeds and filters."""
    out = []
    for notice, (_, key, siblings) in NOTICES.items():
        most = len(notice) // CHARACTERS_AN_ERROR
        at = f" {notice} ".index(f" {key} ")
        before, after = notice[:at], notice[at + len(key) :]
        for m in re.finditer(f"(?= {re.escape(key)} )", f" {plain} "):
            text, first = f" {plain} ", m.start() + 1
            left = text[max(0, first - len(before) - most) : first]
            right = text[first + len(key) : first + len(key) + len(after) + most]
            edits = least_edits(before[::-1], left[::-1]) + least_edits(after, right)
            follows = text[first + len(key) + 1 :].split(" ")[0]
            if edits <= most and follows not in siblings.split():
                out.append((notice, edits))
    return sorted(out)


def fuzzy(text):
    return sorted((m[1], m[2]) for m in find_licenses(text, PHRASES, COMPILED)[1] if m[1])


def test_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scan_licenses(docs).collect():
        text = texts[r.doc_id]
        assert sorted((m.notice, m.edits) for m in r.matches if m.notice) == brute(base(text)[2])
        for m in r.matches:
            assert len(base(text[m.start : m.end])[2].split()) == m.last_word - m.first_word + 1
    for r in op10_license_scans(spark, sf).collect():
        n, found, _ = base(texts[r.doc_id])
        starts = [k for k, _ in found]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_edited_notices_against_brute_force():
    rng = random.Random(11)
    hits = 0
    for _ in range(400):
        parts = []
        for notice in rng.sample(sorted(NOTICES), rng.randrange(1, 4)):
            for _ in range(rng.randrange(len(notice) // 10 + 3)):
                at = rng.randrange(len(notice))
                notice = notice[:at] + rng.choice(["", "q", "é", " "]) + notice[at + rng.randrange(2) :]
            parts += [notice, *["other", "mit", "gnu general public", "nc"][: rng.randrange(4)]]
        text = " ".join(parts)
        want = brute(base(text)[2])
        assert fuzzy(text) == want, text
        hits += len(want)
    assert hits > 300


def test_siblings_are_not_mistaken():
    labels = lambda text: {m[0] for m in find_licenses(text, PHRASES, COMPILED)[1]}
    for name in ("BSD", "ISC", "gpl", "W3C", "PIT"):
        assert labels(f"released under the {name} license") == set()
    for text in ("Licensed under CC BY-SA 4.0", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND"):
        assert labels(text) == set()
    assert "lgpl" not in labels("Licensed under the GNU Affero General Public License")
    assert labels("Licensed under the GNU Lesser General Public License, version 2.1") == {"lgpl", "gpl"}  # the base phrase gives gpl
    assert labels("Licensed under a Creative Commons Attribution-ShareAlike 4.0") == labels("Licensed under a Creative Commons Attribution Non-Commercial") == set()
    # each notice by itself gives its own label and that of a base phrase, no other
    for notice, (label, _, _) in NOTICES.items():
        assert labels(notice) - {x for _, x in base(notice)[1]} <= {label} and label in labels(notice)


def test_no_match_hides_another():
    text = "Released under the MIT licence, or released under the MIT license."
    found = [m for m in find_licenses(text, PHRASES, COMPILED)[1] if m[1]]
    assert [(m[2], text[m[5] : m[6]]) for m in found] == [(1, "Released under the MIT licence"), (0, "released under the MIT license")]


def test_spans_and_edits():
    text = "Ünder: Relaesed under\n\tthe  MIT Licence! Apache-License. mit license mit license"
    n, found = find_licenses(text, PHRASES, COMPILED)
    fuzzy = [m for m in found if m[1] == "released under the mit license"]
    assert len(fuzzy) == 1 and fuzzy[0][2] == 3 and text[fuzzy[0][5] : fuzzy[0][6]] == "Relaesed under\n\tthe  MIT Licence"
    exact = [(m[0], text[m[5] : m[6]]) for m in found if m[1] is None]
    assert exact == [("apache", "Apache-License"), ("mit", "mit license"), ("mit", "mit license")]
    assert find_licenses("released under that mixed licking", PHRASES, COMPILED)[1] == []


def test_many_matches_in_a_long_text():
    text = "released under the mit license\n" * 20_000
    began = time.monotonic()
    n, found = find_licenses(text, PHRASES, COMPILED)
    assert n == 100_000 and len(found) == 40_000 and time.monotonic() - began < 30
    assert found[-1][3:] == (99_998, 99_999, len(text) - 12, len(text) - 1) or found[-1][4] == 99_999


def test_odd_rows(spark):
    rows = scan_licenses(odd_docs(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        if r.doc_id is not None:
            assert r.n_words == base(ODD_TEXTS[r.doc_id])[0] and r.matches == []
    clash = odd_docs(spark).select("doc_id", "text", F.lit(1).alias("matches"), F.lit(2).alias("n_words"), F.lit(3).alias("labels"))
    assert scan_licenses(clash).columns == ["doc_id", "n_words", "matches"]
    assert scan_licenses(empty_docs(spark)).count() == 0
