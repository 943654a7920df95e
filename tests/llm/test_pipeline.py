"""The pipeline against a plain version of each of its stages, each on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_documents import WORD, brute_classes, brute_quality, brute_targets
from tidemark.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, `_key` string, copy long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def fixture():
    rng = random.Random(21)
    rows = []

    def add(text, source):
        rows.append((len(rows), text, "en", source, None if text is None else len(text), "r", "k", 7))

    for i in range(70):
        add(prose(rng, rng.randrange(30, 250)), ["a", "b", "c", None][i % 4])
    for i in range(12):  # near copies
        ws = rows[i % 3][1].split()
        ws[rng.randrange(len(ws))] = "changed"
        add(" ".join(ws), "a")
    for i in range(8):
        add(rows[5][1], "b")
    for i in range(6):
        add(f"{prose(rng, 40)} password = hunter{i}secret! AKIAIOSFODNN7WXYZ{i}ABC {prose(rng, 30)}", "c")
    add(prose(rng, 30) + " 0123456789abcdef01234567 " + prose(rng, 20), "c")
    for text in (None, "", " \n\t", "too few words", "same line here\n" * 40, "x " * 300, "### $$$ " * 30, "!! " * 40):
        add(text, "b")
    add(prose(rng, 4000), "a")
    add(prose(rng, 3), "a")
    rows.append((None, prose(rng, 60), None, None, 5, None, None, None))
    rows.append(rows[4])
    rows.append(rows[4])
    return rows


def rejected(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_quality(text)
    n_lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    return (
        n_words < 10 or 100 * n_repeat > 20 * n_words or 100 * n_symbols > 30 * n_words or 100 * len(re.findall("!!", text or "")) > 30 * n_words
        or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_dup_lines > 50 * n_lines
    )


def plainly_covered(text):
    """No other secrets than these are in the fixture."""
    text = re.sub(r"password = hunter\dsecret", "[assign]", text)
    text = re.sub(r"AKIA[A-Z0-9]{16,}", "[access]", text)
    return re.sub(r"(?<![0-9a-f])[0-9a-f]{24,}", "[hex]", text)


def test_every_stage_is_as_plain(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{i}")
        now = spark.read.parquet(f"{tmp_path}/stage-{i}")
        stages.append([tuple(r) for r in now.collect()])
        if i < 4:
            assert now.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns

    good = [r for r in rows if not rejected(r[1])]
    assert Counter(stages[0]) == Counter(good) and len(good) < len(rows) - 7

    # one document of each group of near copies: the one of the smallest id
    least = {key: None for key in brute_classes([(r[0], r[1], None) for r in good if r[0] is not None], 5, 80, 100, representatives=True)}
    singles = Counter(r for r in good if r[0] in least) | Counter(r for r in good if r[0] is None)
    assert Counter(stages[1]) == Counter(dict.fromkeys(singles, 1))

    covered = []
    for r in stages[1]:
        text = plainly_covered(r[1])
        covered.append((r[0], text, *r[2:4], len(text) if text != r[1] else r[4], *r[5:]))
    assert Counter(stages[2]) == Counter(covered) and Counter(covered) != Counter(stages[1])

    size = defaultdict(int)
    for r in covered:
        size[r[3]] += len(WORD.findall(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_targets([size[s] for s in names]), strict=True))
    whole = {(r[0], r[3]): r for r in covered}
    for s in names:
        own = [r for r in stages[3] if r[3] == s]
        assert sum(len(WORD.findall(r[1])) for r in own) == int(target[s] + 0.5)
        cut = [r for r in own if r != whole[r[0], s]]
        assert len(cut) <= 1 and all(whole[r[0], s][1].startswith(r[1]) and r[4] == len(r[1]) for r in cut)
        assert all(n <= 3 for n in Counter(r[0] for r in own).values())
    assert Counter(r[5:] for r in stages[3]) == Counter(whole[r[0], r[3]][5:] for r in stages[3])

    encode = packing.Encoder(packing.tokenizer_path()).model
    want = Counter()
    for r in stages[3]:
        ids = [*encode.encode(r[1], add_special_tokens=False).ids, 2]
        lo, hi, k = 0, len(ids) % 1024 or min(len(ids), 1024), 0
        while lo < len(ids):
            want[r[0], k, lo, tuple(ids[lo:hi])] += 1
            lo, hi, k = hi, hi + 1024, k + 1
    placed = now.collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in placed) == want
    filled = defaultdict(list)
    for r in placed:
        filled[r.sequence_id].append((r.offset, r.length))
    for x in filled.values():
        ends = [0, *(offset + length for offset, length in sorted(x))]
        assert [offset for offset, _ in sorted(x)] == ends[:-1] and ends[-1] <= 1024
    assert len(filled) <= 1.05 * sum(r.length for r in placed) / 1024 + 1

    # the whole at once gives the rows of its stages
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in again.collect()) == Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in placed)


def test_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
