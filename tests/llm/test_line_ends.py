"""Line dedup with marks at both ends of a document, as the pipeline calls it, against a plain loop."""

from __future__ import annotations

import corpus_pipeline
from visitframe.llm import line_dedup


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str | None, int]]:
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines, gone = [] if text is None else text.split("\n"), set()
        marked = [None, *lines, None]
        for i in range(len(marked) - 2):
            win = tuple(marked[i : i + 3])
            if "".join(x or "" for x in win).strip(" "):
                if win in seen:
                    gone |= {k - 1 for k in range(i, i + 3) if 1 <= k <= len(lines)}
                seen.add(win)
        out[doc_id] = (text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


ROWS = [
    (1, "a lone line"), (2, "a lone line"), (3, "one\ntwo"), (4, "one\ntwo"), (5, "one\ntwo\nthree\nfour"), (6, "zero\none\ntwo"),
    (7, "a lone line\nand more\nto come"), (8, None), (9, ""), (10, "\n"), (11, "x\nx\nx\nx"), (12, "p\nq\nr\ns"), (13, "p\nq\nz\ns"), (14, "m\nn\nr\ns"), (15, "x"), (16, "q\np"), (17, "p\nq"),
]


def test_ends_against_a_loop(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_repeated_lines(docs, ends=True).collect()}
    assert got == brute(ROWS)
    assert got[2] == ("", 1) and got[4] == ("", 2) and got[5] == ("three\nfour", 2) and got[6] == ("zero", 2) and got[14] == ("m\nn", 2)


def test_the_pipeline_drops_copies_of_short_documents(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, t in ROWS[:4]], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()) == [(1, "a lone line", 11), (3, "one\ntwo", 7)]
