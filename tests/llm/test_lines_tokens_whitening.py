import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from citegauge.llm import common, line_dedup, token_align, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_lines string, alignment int, __key__ int"
LINE = "A line that many documents hold"


# lines


def plain_lines(docs, least_chars=10, least_docs=2):
    """{row: (n_lines, n_dropped, kept)} by a plain program."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda k: (k is None, k or 0)
    held = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(rank(doc_id))
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < least_docs or rank(doc_id) == min(held[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ODD = [
    (5, f"{LINE}\nown words of five\n{LINE}\r\nshort\n"),
    (3, f"\t{LINE.upper()} \nshort\n\n{LINE}\nÄrger über Straßen"),
    (9, f"{LINE}\x0b\nshort\nÄRGER ÜBER STRASSEN\nÄrger über Straßen"),
    (9, f"{LINE}\x0b\nshort\nÄRGER ÜBER STRASSEN\nÄrger über Straßen"),
    (9, "another text of the same id"),
    (None, f"{LINE}\nonly null ids hold this"),
    (None, "only null ids hold this\nown words of five"),
    (4, None),
    (6, ""),
    (7, "\n".join(f"numbered line {k % 700} of a long text" for k in range(5000))),
    (8, "\n".join(f"numbered line {k % 900} of a long text" for k in range(5000))),
    (10, f"{LINE} \n{LINE} x"),
]


def test_lines_sql(spark):
    assert_same(spark, line_dedup.op11_line_dedup, line_dedup.ORACLE, SF)


@pytest.mark.parametrize("least_docs", [2, 3])
@pytest.mark.parametrize("few", [False, True])
def test_lines_of_odd_rows(spark, monkeypatch, least_docs, few):
    if few:  # the way of keys too many for a broadcast, hot ones apart
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(common, "HOT_ROWS", 4)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], DOCS)
    out = line_dedup.dedup_lines(docs, least_docs=least_docs)
    assert out.columns == ["doc_id", "text", "n_lines", "alignment", "__key__", "n_lines_", "n_dropped"]
    got = [(r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(plain_lines(ODD, least_docs=least_docs))


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_leave_one_of_each(spark):
    """Applied again, nothing more goes."""
    once = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))
    again = line_dedup.dedup_lines(once.drop("n_lines", "n_dropped"))
    assert once.agg(F.sum("n_dropped")).first()[0] > 0 and again.agg(F.sum("n_dropped")).first()[0] == 0


# tokens


@pytest.fixture(scope="session")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _byte_of():
    """Bytes of the characters that stand for them in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(texts, vocabularies):
    """Rows of the contract by quadratic loops, from the tokenizers' own libraries."""
    a, b = vocabularies
    byte_of = _byte_of()
    found, counts = [], collections.Counter()
    for text in texts:
        sides = [[], []]
        if text:
            sides[0] = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            for k in b.encode(text):
                p = b.id_to_piece(k)
                sides[1].append((k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()))
            if any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
                sides = [[], []]
        spans = []
        for s in sides:
            ends = np.cumsum([len(t) for _, t in s]).tolist()
            spans.append([(k, e - len(t), e) for (k, t), e in zip(s, ends, strict=True)])
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[k for k, _, e in s if low < e <= high] for s in spans] for low, high in zip([0, *cuts], cuts, strict=False)]
        counts.update(links)
        found.append((len(sides[0]), len(sides[1]), links, ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups), len(groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, links, g, n in found]


HARD = [None, "", " ", "a", "  two  spaces\n\n\ttabs\r\n", "<|endoftext|> </s> <0x0A> <s>", "Grüße, naïve café 日本語 🙂👩‍👩‍👧 ▁ under", "▁", "x y​", "wort " * 3000, "a" * 1500, "\x00\x01 zero", "the same", "the same", "ﬁ ½ Å Å"]


@pytest.mark.parametrize("few", [False, True])
def test_alignment_is_that_of_plain_loops(spark, monkeypatch, vocabularies, few):
    if few:
        monkeypatch.setattr(token_align, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(token_align, "SLICE", 4000)
    texts = HARD + [r.text[:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text is not null").limit(25).collect()]
    docs = spark.createDataFrame([(None if k == 3 else 7 if k in (12, 13) else k, t, "x", 1, 2) for k, t in enumerate(texts)], DOCS)
    out = token_align.with_counts(token_align.align(docs, digest=True)).collect()
    got = collections.Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.alignment) for r in out)
    assert got == collections.Counter(plain_alignment(texts, vocabularies))
    assert sum(r.doc_id is None for r in out) == 1 and sum(r.doc_id == 7 for r in out) == 3


def test_alignment_of_whole_documents(spark, vocabularies):
    """Ids, groups and links of all documents; links are as many as pieces that all ends cut."""
    rows = token_align.align(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    a, b = vocabularies
    for r in rows:
        text = texts[r.doc_id]
        if not r.n_a:
            assert not text and r.alignment == "" and r.pairs == []
            continue
        groups = [[s.split(",") for s in g.split("|")] for g in r.alignment.split(";")]
        assert [int(k) for g in groups for k in g[0]] == a.encode(" " + text, add_special_tokens=False).ids
        assert [int(k) for g in groups for k in g[1]] == b.encode(text)
        assert r.n_groups == len(groups) and r.n_links == r.n_a + r.n_b - r.n_groups == sum(p.n for p in r.pairs)


def test_alignment_of_nothing(spark):
    assert token_align.with_counts(token_align.align(spark.createDataFrame([], DOCS))).count() == 0


# whitening


def check_whitening(rows, vectors, components=32, tolerance=1e-7):
    """rows against the whole covariance and its eigenvectors. vectors: {vec_id: entries}."""
    ids = sorted(vectors)
    x = np.array([np.floor(64 * np.array(vectors[k], np.float64)).astype(np.int64) + 1_000_000 for k in ids])
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    values, turns = values[::-1], turns[:, ::-1]
    k = min(components, int((values > values[0] * 1e-11).sum()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    deviation = np.square(n * x - total).sum(axis=1)
    z = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    for j, i in enumerate(ids):
        assert all(got[i, c + 1].n == n and got[i, c + 1].deviation == deviation[j] for c in range(k))
    explained = [got[ids[0], c + 1].explained for c in range(k)]
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    assert got[ids[0], 1].identity_error < 1e-9
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-9
    for c in range(k):
        gap = min([abs(values[c] - values[d]) for d in (c - 1, c + 1) if 0 <= d < len(values)], default=values[0]) / values[0]
        want = centred @ turns[:, c] / np.sqrt(values[c])
        if gap > 1e-6:
            assert np.abs(z[:, c] * np.sign(z[:, c] @ want) - want).max() < tolerance


def test_whitening_is_that_of_the_whole_covariance(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.op13_whitening(spark, SF).collect(), {r.vec_id: r.embedding for r in table.collect()})


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(1).normal(size=(40, 5)).round(3).tolist()
    rows = [(k, v, 1.0) for k, v in enumerate(good)]
    odd = [(100, None, 0.0), (101, [], 0.0), (102, [1.0, None, 0.0, 0.0, 0.0], 0.0), (103, [nan] * 5, 0.0), (104, [inf, 0.0, 0.0, 0.0, 0.0], 0.0)]
    kind = "vec_id long, embedding array<double>, whitened double"
    out = whitening.whiten(spark.createDataFrame(rows + odd, kind))
    check_whitening(out.collect(), dict(enumerate(good)))
    twice = whitening.whiten(spark.createDataFrame([*rows, *rows, (None, good[0], 0.0)], kind))
    assert twice.count() == 81 * 5 and twice.where("vec_id is null").count() == 5
    for given in ([], odd, rows[:1], [(k, [2.0, 3.0], 0.0) for k in range(9)]):  # no vector, or none that differs
        assert whitening.whiten(spark.createDataFrame(given, kind)).count() == 0
    mixed = whitening.whiten(spark.createDataFrame([*rows, (200, [1.0, 2.0], 0.0), (201, [0.0, 5.0], 0.0)], kind)).collect()
    assert {(r.vec_id, r.n) for r in mixed if r.vec_id >= 200} == {(200, 2), (201, 2)}
    check_whitening([r for r in mixed if r.vec_id < 200], dict(enumerate(good)))
    flat = [[a, 2 * a, 7.0, b, -b] for a, b in np.random.default_rng(2).integers(-99, 99, size=(50, 2)).tolist()]
    check_whitening(whitening.whiten(spark.createDataFrame([(k, [float(c) for c in v], 0.0) for k, v in enumerate(flat)], kind)).collect(), dict(enumerate(flat)))


def test_large_entries_are_exact(spark):
    rows = [(0, [1e9, 0.0], 0.0), (1, [1e9 + 1, 3.0], 0.0), (2, [1e9 - 2, 1.0], 0.0)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double"))
    check_whitening(out.collect(), {k: v for k, v, _ in rows}, tolerance=1e-6)
    x = np.array([[2**61, 5], [2**61 - 7, 9]])
    n, total = 3_000_000_000, np.array([2**61 * 3_000_000_000 - 12, 15_000_000_000], object)
    want = [[(int(v) * n - int(t)) / n for v, t in zip(row, total, strict=True)] for row in x]
    assert whitening.centred(x, n, total).tolist() == want


@pytest.mark.parametrize("dim, wanted, block", [(300, 32, 16), (120, 10, 4), (60, 20, 7), (33, 32, 16)])
def test_lanczos_finds_repeated_and_close_values(dim, wanted, block):
    random = np.random.default_rng(dim)
    values = np.sort(np.r_[np.repeat(50.0, block + 3), 49.999, 49.998, random.exponential(5, dim - block - 5)])[::-1]
    turn, _ = np.linalg.qr(random.normal(size=(dim, dim)))
    matrix = turn * values @ turn.T
    passes = []
    got, vectors = whitening.lanczos(lambda q: passes.append(1) or matrix @ q, dim, wanted, block)
    assert np.allclose(got, values[:wanted], rtol=1e-12, atol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-11
    assert len(passes) <= -(-dim // block)


def test_lanczos_begins_anew_after_breakdown():
    """A start inside an invariant space finds the others at random; a matrix of rank two has two values."""
    matrix = np.diag([5.0, 4.0, 3.0, 2.0, 1.0, 0, 0, 0, 0, 0])
    got, _ = whitening.lanczos(lambda q: matrix @ q, 10, 6, 3)
    assert np.allclose(got, [5, 4, 3, 2, 1, 0], atol=1e-12)
    low = np.zeros((40, 40))
    low[0, 0], low[1, 1] = 9.0, 4.0
    got, _ = whitening.lanczos(lambda q: low @ q, 40, 5, 4)
    assert np.allclose(got, [9, 4, 0, 0, 0], atol=1e-12)
