"""Operators 11 to 13 against brute force, with null, empty, long, repeated and clashing rows."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import importance, merkle, ranks, tokenfiles

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (7, "a", "en", 3, "Ab c, it's  two\n\nlines. É, à.B"), (7, "a", "en", 3, "Ab c, it's  two\n\nlines. É, à.B"), (7, "b", None, None, None), (None, None, None, 0, "No id Here"), (3, "", "", 0, ""),
    (5, "a", "en", 1, "x" * 3000), (6, "a", "en", 9, "word Two-three four 5five " * 9000), (8, "a", "de", 2, "<|endoftext|>   café  .,. a,b"), (9, "a", "de", 2, " ,. "), (2, "z", "fr", 1, "One word or a few Words to be drawn, as many as it takes: a b c d e f g h i j k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


def rows_of(spark, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


# ---- 11


def files(spark, docs):
    folder = tempfile.mkdtemp(prefix="spark-tokens-") + "/out"
    return folder, tokenfiles.write_tokens(docs, folder, tokenfiles.default_path())


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids + [2] for x in Tokenizer.from_file(tokenfiles.default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_are_the_librarys():
    random.seed(5)
    alphabet = [*"ab  c\n\t'sdtl.,!1é ñ", " ", "　", "中", "\x1c", "\x85", "̀", "<|endoftext|>", " 're", "×", "÷", "ß."]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(4000)] + ["", " ", "a" * 5000, "x y " * 3000]
    own = tokenfiles.Pieces(tokenfiles.default_path())
    ids, count = own.encode([t.encode() for t in texts])
    at = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x[:-1] for x in library(texts)]


def test_other_tokenizers_take_whole_texts():
    own = tokenfiles.Pieces(tokenfiles.default_path().replace("byte_bpe_50k", "word_bpe_49k"))
    assert not own.cuts
    ids, count = own.encode([b"Hello there, world", b""])
    assert ids.tolist() == own.tokenizer.encode("Hello there, world", add_special_tokens=False).ids and count[1] == 0


def test_token_files(spark, odd):
    folder, shards = files(spark, odd.withColumn("start", F.lit(1)).withColumn("ids", F.lit("x")))
    got = sorted(map(tuple, tokenfiles.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x))
    expected = sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(ODD, library([r[4] for r in ODD]), strict=True))
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == expected
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    whole = {(r["start"]): r["ids"] for r in tokenfiles.read_tokens(spark, folder).collect()}
    flat = [x for k in sorted(whole) for x in whole[k]]
    corpus = tokenfiles.Corpus(spark, folder)
    assert corpus.size == len(flat) and corpus.window(0, corpus.size + 5).tolist() == flat and corpus.window(7, 30).tolist() == flat[7:37]
    assert shards.agg(F.sum("n_tokens"), F.sum("n_docs")).first() == (len(flat), len(ODD))


def test_empty_token_files(spark, odd):
    folder, shards = files(spark, odd.limit(0))
    assert shards.count() == 0 and tokenfiles.read_digests(spark, folder).count() == 0 and tokenfiles.Corpus(spark, folder).window(0, 9).size == 0


def test_op11_query(spark):
    docs = sorted(rows_of(spark))
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenfiles.op11_tokenfiles(spark, SF).collect()}
    at = 0
    for r, ids in zip(docs, library([r[4] for r in docs]), strict=True):
        assert got[r[0]] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---- 12


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], r[4])))


def levels(h):
    out = [h]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(lv, i):
    out = []
    for level in lv[:-1]:
        b = i // 8 * 8
        run = level[b : b + 8]
        out.append(("".join(run[: i - b]), "".join(run[i - b + 1 :])))
        i //= 8
    return out


def merkle_expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in groups[k]])
    crown = levels([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path, now = siblings(trees[k], i) + siblings(crown, j), trees[k][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf((*r[:4], r[4] and r[4].translate(LOWER)))
            for a, b in path:
                now = H(a + now + b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], crown[-1][0], H("".join(a + b for a, b in path)), now, now == crown[-1][0]))
    return sorted(out, key=str)


def merkle_query(spark, docs, tmp):
    docs.write.parquet(f"{tmp}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, str(tmp)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_op12_odd_rows(spark, odd, tmp_path):
    assert merkle_query(spark, odd.withColumn("digest", F.lit(1)).withColumn("n", F.lit("x")), tmp_path) == merkle_expected(ODD)


def test_op12_one_row_and_none(spark, odd, tmp_path):
    one = odd.where("doc_id = 5")
    (got,) = merkle_query(spark, one, tmp_path / "one")
    assert got[1] == got[2] == got[3] and got[4] == H("")
    assert merkle_query(spark, odd.limit(0), tmp_path / "none") == []


def test_op12_many_groups(spark, tmp_path):
    random.seed(3)
    rows = [(i, "s", random.choice([None, *"abcdefghijklmn", "é"]) if i > 300 else "hot", i, f"Text {i}") for i in range(400)]
    assert merkle_query(spark, spark.createDataFrame(rows, COLUMNS).repartition(5), tmp_path) == merkle_expected(rows)


def test_merkle_intervals(spark):
    leaves = spark.createDataFrame([("g", i, hashlib.sha256(str(i).encode()).digest()) for i in range(70)], "grp string, id long, digest binary")
    paths, tree, _ = merkle.manifest(leaves, [F.col("grp"), F.col("id")])
    nodes = [tuple(r)[:4] for r in tree.nodes().where("level > 0").orderBy("level", "lo").collect()]
    assert nodes == [("g", 1, i, min(i + 8, 70)) for i in range(0, 70, 8)] + [("g", 2, 0, 64), ("g", 2, 64, 70), ("g", 3, 0, 70)]
    folded = paths.select(merkle.fold(F.lower(F.hex("digest")), F.col("path")).alias("f"), "root").collect()
    assert len(folded) == 70 and all(f == r for f, r in folded)


def test_ranks_of_a_hot_group(spark):
    random.seed(8)
    rows = [(random.choice("aaaab") if i % 9 else None, random.randrange(200)) for i in range(3000)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int").repartition(7), [F.col("g").asc_nulls_first(), F.col("v")], "g").collect()
    for g in (None, "a", "b"):
        mine = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for x, v in rows if x == g)
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}


# ---- 13

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def importance_expected(rows, target):
    found = [feature_buckets(r[4]) for r in rows]
    s, t = np.zeros(10000, np.int64), np.zeros(10000, np.int64)
    for _, f in found:
        np.add.at(s, np.array(f, np.int64), 1)
    for x in target:
        np.add.at(t, np.array(feature_buckets(x)[1], np.int64), 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for r, (n, f) in zip(rows, found, strict=True):
        weight, score = sum(gain[b] for b in f) // len(f) if f else 0, None
        if r[0] is not None:
            h = int(hashlib.sha256(f"7:{r[0]}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r[0], len(f), weight, score, n))
    able = sorted((r for r in out if r[0] is not None and r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = len(able) * 25 // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if r[0] is None or r[4] < 20], key=str)


def test_crcs_of_words_and_pairs():
    random.seed(1)
    words = [bytes(random.choices(range(97, 123), k=random.choice([1, 2, 5, 31, 32, 33, 70, 300]))) for _ in range(500)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    crc = importance.word_crcs(data, ends - size, ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert importance.pair_crcs(crc, size).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_op13_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 1000)  # the long text comes in slices
    target = ["a few words", None, "", "a few words", "Two-three four"]
    got = importance.resample(odd.withColumn("rank", F.lit(1)).withColumn("score", F.lit(1)), spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == importance_expected(ODD, target)
    none = importance.resample(odd.limit(0), spark.createDataFrame([], "text string"))
    assert none.count() == 0


def test_op13_query(spark):
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, importance.op13_importance(spark, SF).collect()), key=str) == importance_expected(rows_of(spark), target)


def test_sort_with_ties(spark):
    random.seed(2)
    rows = [(i % 700, random.choice([5, 5, 5, random.randrange(50)])) for i in range(2000)]
    got = importance.sort_ranks(spark.createDataFrame(rows, "doc_id long, score long").repartition(6), samples=60).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 2001)) and [(r["doc_id"], r["score"]) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_no_markup_stops_a_sequence():
    from logspark.llm import media

    assert [x["text"] for x in media.sequence("<p>a<![if x]>b<![endif]>c<![CDATA[ > ]]>d<![bad[ x>e</p>")] == ["abcde"]
    assert media.sequence("<!<![]]>[xpCDATA[</") is not None
    rng = random.Random(12)
    parts = ["<!", "[", "]", "]]>", ">", "CDATA[", "<![", "<!--", "--", "if x", "</", "<p", "<img src=a", "<?", "&#", "&amp", "x", " ", "\n", '"', "'", "=", "<script>", "</script", "<!doctype", "<figure>", "<figcaption>"]
    for _ in range(30_000):
        media.sequence("".join(rng.choices(parts, k=rng.randrange(1, 14))))
