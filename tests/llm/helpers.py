"""Small tables for the cases that every operator must bear."""

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "a b c d",
    "  two  spaces ",
    "É ▁ \u0001 \u0002 x\x00y 日本語 👍🏽",
    "same words again and again " * 3,
    "same words again and again " * 3,
    "x" * 5000,
    "long text of many words " * 4000,
]


def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and extra columns."""
    rows = [(i, t, "en", "a" if i % 3 else None, None if t is None else len(t), i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[8], (None, None, None, None, None, None), (None, "no id here at all", None, "b", 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int")


def empty_docs(spark):
    return odd_docs(spark).limit(0)
