"""Line-first cleaning: rules judge each line, and a document that loses too much of its text goes.

A word is a run outside 0x20 and 0x09-0x0D; lines are what ``\\n`` parts.  Each
line with a word is held against rules of punctuation, navigation and
boilerplate.  Lines that fail are taken out; what they weigh against the whole
text decides about the document.  Counts of the whole text (words, symbols,
repeated lines and windows) stand before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.wordscan import SPACE, Words, scan

WINDOW = 5
LEAST_WORDS = 10
#: Percent of the words that may stand in repeated windows, and of the characters that failed lines may hold.
MOST_REPEATED = 20
MOST_LOST = 50
#: A line that stops without the end of a sentence still is prose if so many words hold one such end.
SENTENCE_WORDS = 50
#: A line of more words is no boilerplate, whatever it mentions.
BOILERPLATE_WORDS = 25

#: What ends a sentence, what may follow it, symbols, and words that part the entries of a menu.
SENTENCE_END = r"[.!?:;…。！？؟।][\"')\]»”’]*(?:[\x20\x09-\x0D]|$)"
STOPS = r"[.!?:;…。！？؟।][\"')\]»”’]*[\x20\x09-\x0D]*$"
SYMBOL = r"[#*$%&|<>]"
EXCITED = r"[!?]{2,}"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:\||>|»|›|/|·|•|::|-|–)"
WORD = r"[^\x20\x09-\x0D]+"

#: Phrases of notices, licences and calls to act, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "is licensed", "under the gnu", "copyright ©", "copyright (c)", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "uses cookies", "accept cookies", "accept all cookies", "enable javascript", "powered by", "subscribe to", "sign up for", "log in to", "click here", "read more",
    "share this", "share on", "follow us", "back to top", "skip to content", "leave a comment", "related articles",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "mehr lesen", "jetzt abonnieren",
    "todos los derechos reservados", "política de privacidad", "utiliza cookies", "leer más", "suscríbete",
    "tous droits réservés", "politique de confidentialité", "utilise des cookies", "lire la suite", "abonnez-vous",
)
BOILERPLATE_PATTERN = "|".join(re.escape(x).replace(r"\ ", " ") for x in BOILERPLATE)

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in SYMBOL[1:-1]]] = True
_end, _stops, _symbol, _excited, _separator, _word, _notice = (re.compile(p) for p in (SENTENCE_END, STOPS, SYMBOL, EXCITED, SEPARATOR + r"(?=[\x20\x09-\x0D]|$)", WORD, BOILERPLATE_PATTERN))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def failed_rule(line: str) -> str | None:
    """The first rule that a line with a word fails: punctuation, navigation, boilerplate; None if none.

    Punctuation: no end of a sentence, neither at the line's end nor one to
    SENTENCE_WORDS words, or more than a symbol, or a run of exclamation or
    question marks, to five words.  Navigation: at least two words that only part
    entries, and one of them to four words.  Boilerplate: a notice of at most
    BOILERPLATE_WORDS words.
    """
    n = len(_word.findall(line))
    separators = len(_separator.findall(line))
    if separators >= 2 and 4 * separators >= n:
        return "navigation"
    if n <= BOILERPLATE_WORDS and _notice.search(line.translate(_LOWER)):
        return "boilerplate"
    stops = _stops.search(line) or SENTENCE_WORDS * len(_end.findall(line)) >= n
    if not stops or 5 * len(_symbol.findall(line)) > n or 5 * len(_excited.findall(line)) > n:
        return "punctuation"
    return None


def repeated_words(words: Words) -> np.ndarray:
    """For each word of a batch: whether a window of WINDOW words that covers it occurs twice in its text."""
    at, hashes = words.grams(WINDOW)
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int32)
    if len(at):
        docs = words.docs[at]
        order = np.lexsort((hashes, docs))
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (docs[order[1:]] == docs[order[:-1]])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _judge(text: str) -> tuple[int, int, int, int, int, int, str]:
    """Of one text: lines with a word, repeated ones, lines failed by rule (three), word characters lost, the text left."""
    seen, left, repeated, lost = set(), [], 0, 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    n = 0
    for line in text.split("\n"):
        if not _word.search(line):
            left.append(line)
            continue
        n += 1
        repeated += line in seen
        seen.add(line)
        rule = failed_rule(line)
        if rule is None:
            left.append(line)
        else:
            failed[rule] += 1
            lost += sum(map(len, _word.findall(line)))
    return n, repeated, failed["punctuation"], failed["navigation"], failed["boilerplate"], lost, "\n".join(left)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")


def _measure(with_text: bool):
    names = [*_COUNTS, *(["clean_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            for first, words in scan(texts):
                own = texts.slice(first, len(words.bounds) - 1)
                ends = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False))
                offsets = np.concatenate([[0], ends])
                total = lambda flags, o=offsets: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[o])
                chars = total(~SPACE[words.data] & ((words.data & 0xC0) != 0x80))
                symbols = total(_SYMBOLS[words.data])
                repeats = np.diff(np.concatenate([[0], np.cumsum(repeated_words(words), dtype=np.int64)])[words.bounds])
                judged = [_judge(t) for t in own.to_pylist()]
                lines = np.array([j[:6] for j in judged], dtype=np.int64).reshape(-1, 6)
                counts = [np.diff(words.bounds), chars, symbols, lines[:, 1], repeats, lines[:, 0], *lines[:, 2:].T]
                arrays = [*(pa.array(c.astype(np.int64)) for c in counts), *([pa.array([j[6] for j in judged], pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(own)), *arrays], names=["doc_id", *names])

    return run


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST, with_text: bool = True) -> DataFrame:
    """One row per input row: counts of its text, what the line rules took, and whether it is kept.

    Columns: the id, n_words, word_chars (code points in words), n_symbols,
    n_dup_lines (lines with a word that equal an earlier one), n_repeat_words
    (words in windows of five that occur twice or more), base_failed (under
    LEAST_WORDS words or over MOST_REPEATED percent of them repeated), kept
    (false if base_failed, or if failed lines hold over ``most_lost`` percent of
    word_chars), n_lines, n_punctuation, n_navigation, n_boilerplate (lines
    failed by rule), lost_chars, clean_text (the lines left, unless not wanted).

    Null counts as empty and fails the base; an empty table gives an empty
    result; repeated rows come out each, other columns are not read.  A window
    is known by a 64-bit hash.  A text's words take some 100 bytes each in its
    task.  Nothing is shuffled.
    """
    columns = ", ".join([f"{c} long" for c in _COUNTS] + ["clean_text string"] * with_text)
    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure(with_text), f"doc_id {kind}, {columns}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
        .select(F.col("doc_id").alias(id_col), *_COUNTS[:5], "base_failed", "kept", *_COUNTS[5:], *(["clean_text"] if with_text else []))
    )
