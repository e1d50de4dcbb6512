from __future__ import annotations

import re
from collections import Counter

import pytest

from sondeframe.llm import line_rules as R

PROSE = "The river rose in spring and the mills along it turned again. Nobody had expected so much water so early."


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {p for i, w in enumerate(windows) if many[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    lost = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in lines if R.failed_rule(x))
    chars = sum(map(len, words))
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, not failed and 100 * lost <= R.MOST_LOST * chars


@pytest.mark.parametrize(("line", "rule"), [
    (PROSE, None), ("“Is it late?”", None), ("Home | News | Sport | Weather", "navigation"), ("Start » Shop » Shoes", "navigation"), ("One side | two sides of it.", None),
    ("All Rights Reserved.", "boilerplate"), ("This site uses cookies to serve you.", "boilerplate"), (f"{PROSE} A bakery that uses cookies as money is rare, and few have heard of it.", None),
    ("Latest stories from around", "punctuation"), ("buy### now### cheap###.", "punctuation"), ("BUY!! NOW!! CHEAP!!", "punctuation"), (PROSE + " It went on without", None), ("a\x0bb.", None),
])
def test_rules(line, rule):
    assert R.failed_rule(line) == rule


def test_against_brute_force(docs_of, rng):
    pieces = [PROSE, "Home | News | Sport", "All rights reserved.", "", " \t", "same line here.", "same line here.", "über den Fluss 東京 ging er.", "x# y# z#", " kept as a word.", "a b c d e a b c d e.", "\r"]
    texts = [None, "", " \n ", PROSE, PROSE + "\n" + PROSE, "one", "Home | News | Sport"] + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    rows = [*enumerate(texts), (3, PROSE), (None, PROSE)]
    found = R.line_quality(docs_of(rows).repartition(3)).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in found), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in found:
        assert not any(R.failed_rule(x) for x in r["clean_text"].split("\n") if x.strip(" \t\n\r\x0b\x0c"))


def test_documents_that_lose_too_much_go(docs_of):
    menu = "Home | News | Sport | Weather | Travel | Money\n" * 2
    prose = "\n".join(f"Line {k} of a story about {k} boats tells what became of number {k}." for k in range(8))
    found = {r["doc_id"]: r for r in R.line_quality(docs_of([(1, menu + prose), (2, menu * 3 + prose[:60] + ".")])).collect()}
    assert found[1]["kept"] and found[1]["clean_text"] == "\n" + prose or found[1]["clean_text"] == prose
    assert not found[2]["kept"]


def test_empty_table_and_long_text(docs_of):
    assert R.line_quality(docs_of([]).limit(0)).count() == 0
    one = R.line_quality(docs_of([(1, " ".join(f"w{k}" for k in range(600_000)) + ".")]), with_text=False).first()
    assert (one["n_words"], one["n_repeat_words"], one["kept"]) == (600_000, 0, True)


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    judged = R.line_quality(spark.read.parquet(f"{sf}/documents.parquet"), with_text=False).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, kept, junk, left = judged.selectExpr(
        "count_if(quality = 1 AND NOT base_failed)", "count_if(quality = 1 AND NOT base_failed AND kept)", "count_if(quality = 0)", "count_if(quality = 0 AND kept)").first()
    assert kept >= 0.98 * good and left <= 0.02 * junk
