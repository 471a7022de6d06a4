"""The five stages on a small corpus, each held against brute force on its own input."""

import random
import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_copies import brute as near_copies  # noqa: E402
from test_linededup import brute as without_near_lines  # noqa: E402
from lotwise.llm import secrets  # noqa: E402
from lotwise.llm.queries import word_vocabulary  # noqa: E402
from texts import prose  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents before each stage and of the result."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(11)
    rows, labels = [], []
    shared = prose(rng, 30)
    for n in range(160):
        bad = n % 5 == 0
        lines = [prose(rng, rng.randint(6, 40)) for _ in range(rng.randint(1, 6))]
        if bad:
            lines = [" | ".join(x.upper().split()) + "!!" for x in lines]
        elif n % 7 == 0:
            lines.insert(1, shared + rng.choice(["", " more"]))
        if n % 11 == 1:
            lines.append("api_key = " + "".join(rng.choice("abcdef0123456789") for _ in range(20)))
        rows.append((n, "\n".join(lines), "en", "s", 0))
        labels.append((n, int(not bad), 0))
    for n in range(160, 172):  # near copies on one line, and exact copies
        words = rows[n - 159][1].replace("\n", " ").split()
        if n % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((n, " ".join(words) + f" tail{n}", "en", "s", 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (2, rows[2][1], "en", "s", 0), (403, rows[3][1], "fr", "t", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    seen.append(docs.collect())
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
        if number < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == docs.columns and whole.count() == len(seen[-1])
    return seen


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_rejects_the_bad_and_keeps_the_clean(stages):
    kept = set(texts(stages[1]))
    assert {n for n in range(160) if n % 5} <= kept and len(kept & {n for n in range(160) if n % 5 == 0}) <= 2
    assert all(texts(stages[0])[n] == t for n, t in texts(stages[1]).items())


def test_lines(stages):
    given = sorted(stages[1], key=lambda r: r.doc_id)
    wanted, links, gone = without_near_lines([r.text for r in given])
    found = sorted(stages[2], key=lambda r: r.doc_id)
    assert gone and [(r.doc_id, r.text) for r in found] == [
        (r.doc_id, t) for r, t in zip(given, wanted, strict=True) if t.strip() or not (r.text or "").strip()
    ]
    assert all(r.n_chars == len(r.text) for r in found)


def test_copies(stages):
    given = sorted(stages[2], key=lambda r: r.doc_id)
    groups = near_copies([r.text for r in given], 80, 5)
    assert sorted(r.doc_id for r in stages[3]) == [given[n].doc_id for n in sorted(groups) if groups[n][1] == n]
    assert len(stages[3]) < len(stages[2])


def test_secrets(stages):
    for n, text in texts(stages[3]).items():
        for _, start, end in reversed(secrets.find_spans(text or "")):
            text = text[:start] + "[secret]" + text[end:]
        assert texts(stages[4])[n] == text
    assert any("[secret]" in (t or "") for t in texts(stages[4]).values())


def test_packing(stages):
    library = Tokenizer.from_file(word_vocabulary())
    pieces = {}
    for p in sorted(stages[5], key=lambda p: p.start):
        pieces.setdefault(p.doc_id, []).extend(p.token_ids)
    assert pieces == {n: [*library.encode(t or "", add_special_tokens=False).ids, 2] for n, t in texts(stages[4]).items()}


def test_copies_without_an_id_or_of_one_id(spark, tmp_path):
    text, other = prose(random.Random(3), 40), prose(random.Random(4), 40)
    rows = [(7, text), (None, other), (None, other), (3, other), (5, text), (5, text), (5, None), (5, ""), (6, text + " x"), (None, None)]
    frame = spark.createDataFrame([(n, t, "en", "s", 0) for n, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/docs")
    found = corpus_pipeline.copies(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    wanted = [(5, text), (None, other), (5, None), (5, ""), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, wanted))
