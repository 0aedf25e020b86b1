"""Merkle manifest, token store and fill-in-the-middle against brute force, exact round trips and the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from factloom.llm import fillmiddle, merkle, queries, repair, tokenstore  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long"
FILE = public_tokenizers.path("word_bpe_49k.json")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma,", "délta", "ÉPÉE", "it's", "the", "of", "x\ny", "42"])
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(70)]
    texts += [None, "", " ", "\n\n", "a" * 5000, "no end \n" * 3000, "日本語のテキスト。" * 30, "<P> in it", "x<S", "\U0001f600 é ̸= <|endoftext|> Σς İ", "a\tb\x1cc　d", texts[0], texts[1]]
    out = [(3 * i - 40, t, rnd.choice(["en", None]), rnd.choice(["s0", "s0", "s0", "é", "s1", "", None]), rnd.choice([None, i])) for i, t in enumerate(texts)]
    out += [(500 + i, f"lone {i}", "en", f"t{i}", 1) for i in range(11)]
    return [*out, out[5], out[5], (7, "one id", "en", "s0", 1), (7, "another text", "en", "s0", 2), (None, "no id", "en", "s0", 5), (None, "no id", "en", "s0", 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("outputs"))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], DDL).write.parquet(f"{at}/none/documents.parquet")
    return at


def lift(nodes: list[tuple[str, list]]) -> tuple[str, dict[int, list[tuple[list[str], list[str]]]]]:
    """The top of a tree over digests and, for each leaf, its steps."""
    steps = {i: [] for i in range(len(nodes))}
    level = [(d, [i]) for i, d in enumerate(nodes)]
    while len(level) > 1:
        made = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k, (_, under) in enumerate(run):
                for i in under:
                    steps[i].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            made.append((sha("".join(d for d, _ in run)), [i for _, under in run for i in under]))
        level = made
    return level[0][0], steps


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault((r[3] is not None, (r[3] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups)
    lifted = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        lifted[g] = lift([x[2] for x in groups[g]])
    root, high = lift([lifted[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, digest, r) in enumerate(groups[g]):
            path = lifted[g][1][i] + high[k]
            at = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                at = leaf(r, r[1].replace("\n", ""))
            for left, right in path:
                at = sha("".join(left) + at + "".join(right))
            out.append((r[0], digest, lifted[g][0], root, sha("".join(d for left, right in path for d in left + right)), at, at == root))
    return out


def test_manifest_equals_brute_force(spark, folder, rows):
    got = [tuple(r) for r in queries.op11_merkle(spark, folder).collect()]
    want = brute_manifest(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r[6] for r in got} == {True, False}
    assert queries.op11_merkle(spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 800])
def test_manifest_of_one_group_and_of_lone_leaves(spark, n):
    one = [(i, str(i), "en", "s", i) for i in range(n)]
    for rows in (one, [(i, t, lang, f"s{i}", c) for i, t, lang, _, c in one]):
        docs = spark.createDataFrame(rows, DDL).withColumn("LEAF", F.lit("clash"))
        got = merkle.manifest(docs, FIELDS, "source", "doc_id", ["doc_id", "LEAF"]).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"), merkle.fold(F.col("leaf"), F.col("path")).alias("f")).collect()
        assert sorted(tuple(r) for r in got) == sorted((r[0], r[1], r[2], r[3], r[4], r[3]) for r in brute_manifest(rows))


def test_grammar_round_trips_and_opens_ranges():
    np = pytest.importorskip("numpy")
    rnd = random.Random(9)
    cases = [[], [3], [1, 1], [7] * 1000, [1, 2] * 500 + [2, 1] * 500, [rnd.randrange(4) for _ in range(5000)], [rnd.randrange(50) for _ in range(300)] * 20, [rnd.randrange(10**6) for _ in range(2000)]]
    for ids in cases:
        for least in (2, 3, 16):
            grammar = repair.compress(np.array(ids, np.uint32), 10**6, least)
            back = repair.loads(repair.dumps(grammar))
            assert back.decode().tolist() == ids
            for _ in range(20):
                a, b = rnd.randrange(-2, len(ids) + 3), rnd.randrange(-2, len(ids) + 3)
                assert back.decode(a, b).tolist() == ids[max(0, a) : max(0, b)]
            for k in range(len(back.left)):
                size = len(back.expand(np.array([10**6 + k], np.int32)))
                assert size == back.lengths[k] and max(back.left[k], back.right[k]) < 10**6 + k
            # no pair is left that occurs often enough without overlapping itself
            pairs, seq, at = {}, back.sequence.tolist(), {}
            for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
                if at.get(pair, -2) < i - 1 or pair[0] != pair[1]:
                    pairs[pair] = pairs.get(pair, 0) + 1
                    at[pair] = i
            assert max(pairs.values(), default=0) < least or least == 2 and max(pairs.values()) <= 2
    assert len(repair.compress(np.array([1, 2, 3, 4] * 4096, np.uint32), 10, 2).sequence) < 16
    with pytest.raises(ValueError):
        repair.compress(np.array([10], np.uint32), 10)
    with pytest.raises(ValueError):
        repair.loads(b"XXXX" + repair.dumps(repair.compress(np.array([1], np.uint32), 10))[4:])


def test_encoder_equals_the_library(rows):
    own = tokenstore.encoder(tokenstore._content(FILE))
    assert own.by_words
    given = [r[1] or "" for r in rows] + ["á b ́c", "I'LL don't 'S '' ?!,", "K Å ﬁ ÅB ßß Ÿ ÿ × ÷ a×b", "<|ENDOFTEXT|> <|endoftext|>.", "≠ ≠ a,̸", "word,́ word.x W.O.R.D", "\r\n\t a", "ǅ ǆ Ω µ"]
    for text in given:
        assert own.ids(text) == own.plain(text), text
    own.by_words = False
    assert own.ids("Some text") == own.plain("Some text")
    own.by_words = True


def test_encoder_meets_a_word_once_whatever_its_marks():
    import pyarrow as pa

    own = tokenstore.Encoder(tokenstore._content(FILE))
    marks = ["", ",", ".", "...", "!?", "***", "|>", "<|", "')", "'", "#%&"]
    odd = ["<|endoftext|>", "a<|endoftext|>", "<|endoftext", "q\u0301", "e\u0301", "€", "×", "a×", "´", "it's", "'s", "x'", "42", "x²", "Ⅻ", "İ", "ß", "Ÿ", "Σς", "a,b", "a\u0338", "\u200d", "語"]
    texts = [f"{w}{m}" for w in odd for m in marks]
    texts += [None, "", " ", "\n", " ".join(texts), "\n".join(texts), "a, \u0338", "w" * 3000 + "."]
    for given in (pa.array(texts), pa.array(texts).slice(5), pa.array(texts, pa.large_string()), pa.array([None], pa.string()), pa.array([""]), pa.array([], pa.string())):
        assert own.every(given).to_pylist() == [own.plain(t) if t else b"" for t in given.to_pylist()]
    own.words.clear()
    mixed = [f"{w}{m}" for w in ("word", "Épée", "x1") for m in marks]
    assert own.every(pa.array([" ".join(mixed)])).to_pylist() == [own.plain(" ".join(mixed))]
    # the characters of added tokens are no marks, so words that end in one stay whole
    assert {w for w in own.words if any(c.isalnum() for c in w)} == {"word", "Épée", "épée", "x1"} | {f"{w}{m}" for w in ("word", "Épée", "x1") for m in ("<|", "|>")}


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_store_equals_the_library(spark, folder, rows):
    import struct

    ids = library_ids([r[1] for r in rows])
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for block, least in ((tokenstore.BLOCK, tokenstore.LEAST), (700, 2)):  # small blocks: documents in pieces
        shards = tokenstore.write(docs, FILE, block=block, least=least)
        got = tokenstore.read(shards).collect()
        assert sorted((crc(x), len(x)) for x in ids) == sorted((zlib.crc32(r["ids"]), r["n_tokens"]) for r in got)
        got.sort(key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        assert order == sorted(order)
    out = queries.op12_token_store(spark, folder).collect()
    assert sorted((r["doc_id"] or -10**9, r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((r[0] or -10**9, len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    assert queries.op12_token_store(spark, f"{folder}/none").count() == 0


def test_ranges_of_documents(spark, folder, rows):
    ids = library_ids([r[1] for r in rows])
    by = {}
    for r, x in zip(rows, ids, strict=True):
        by.setdefault(r[0], []).append(x)
    shards = tokenstore.write(spark.read.parquet(f"{folder}/documents.parquet"), FILE, block=700, least=2)
    rnd = random.Random(1)
    spans = [(d, a, a + rnd.randrange(0, 900)) for d in by for a in (0, rnd.randrange(0, 30), 699)] + [(99999, 0, 3), (None, 0, 1)]
    spans = sorted({s for s in spans if s[0] is not None}) + [(None, 0, 1)]
    got = tokenstore.take(shards, spark.createDataFrame(spans, "doc_id long, begin long, end long")).collect()
    want = [(d, a, b, x[a:b]) for d, a, b in spans if d is not None for x in by.get(d, [])]
    assert sorted((r["doc_id"], r["begin"], r["end"], list(r["ids"])) for r in got) == sorted(want)


def brute_middle(doc, text):
    text = text or ""
    h = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fill_in_middle_equals_brute_force(spark, folder, rows):
    got = [tuple(r) for r in queries.op13_fill_in_middle(spark, folder).collect()]
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(got, key=order) == sorted((brute_middle(r[0], r[1]) for r in rows), key=order)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert queries.op13_fill_in_middle(spark, f"{folder}/none").count() == 0
    clash = spark.createDataFrame(rows, DDL).withColumns({"OUTPUT": F.lit("x"), "form": F.lit("y")})
    out = fillmiddle.transform(clash, seed=2, share=100, suffix_first=50)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    back = out.select("text", fillmiddle.restored().alias("back"), "form").collect()
    assert all(r["back"] == (r["text"] or "") for r in back) and {r["form"] for r in back} == {"plain", "spm", "psm"}


def test_checkpoints_find_every_unit(monkeypatch):
    monkeypatch.setattr(fillmiddle, "WINDOW", 7)
    rnd = random.Random(4)
    for trial in range(60):
        text = "".join(rnd.choice(["a", "Zb", "9", " ", "é", "日", "\U0001f600", "@", "[", "{", "\x00", "é"]) for _ in range(rnd.randrange(0, 90)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        index = fillmiddle.Checkpoints(text.encode(), stride=rnd.choice([1, 2, 5, 64]))
        assert (index.n, index.chars) == (len(units), len(text)), trial
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.locate(k) == (len(head.encode()), len(head)), (trial, k)
    monkeypatch.undo()
    long = "word 9é" * 600_000
    index = fillmiddle.Checkpoints(long.encode())
    assert index.n == 4 * 600_000 and index.locate(1_234_567) == (lambda h: (len(h.encode()), len(h)))("".join(re.findall(r"[A-Za-z]+|[^A-Za-z]", long)[:1_234_567]))
