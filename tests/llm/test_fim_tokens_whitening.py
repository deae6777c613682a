"""Fill-in-middle, token counts and whitening against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from linkweave.llm import fill_in_middle, queries, token_counts, whitening

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "a\x00b", "\x01\x02\x02\x01 1\x021\x010ab", "\x01" * 5, "\x02" * 5, "has <P> in it", "<", "ab<S", "😀é x\r\ny" * 7, "x" * 4000, "word " * 3000, "中文字 x", "don't stop", "<|endoftext|>", "a <|endoftext|><|endof", "same", "same"]


def _clash(spark, texts):
    """Texts with every column name that an operator might take for itself."""
    rows = [(n, t, "kept", 7, n) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, __fim string, __tokens int, n long")


# fill in middle


def _fim(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"


def test_fim_against_brute_force(spark):
    dice = random.Random(3)
    bits = ["a", "Word", " ", "\x01", "\x02", "0", "1", "<", "<P", ">", "S>", "é", "😀", "\n", "\u0085"]
    texts = [(n, t) for n, t in enumerate(ODD)] + [(100 + n, "".join(dice.choice(bits) for _ in range(dice.randrange(30)))) for n in range(400)] + [(None, "a b c"), (None, "a b c"), (-5, "x y z")]
    got = fill_in_middle.fim_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(f := _fim(i, t))[:4], sha(f[4]), sha(t or "")) for i, t in texts]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_columns_and_parameters(spark):
    made = fill_in_middle.fill_in_middle(_clash(spark, ["one two three"] * 40), percent=100, spm_percent=100, seed=9, markers=fill_in_middle.Markers("[pre]", "[suf]", "[mid]"))
    assert made.columns == ["doc_id", "text", "__fim", "__tokens", "n", "fim"]
    for r in made.collect():
        assert (r["__fim"], r["n"], r["fim"]["form"], r["fim"]["n"]) == ("kept", r["doc_id"], "spm", 5)
        assert r["fim"]["output"] == f"[suf]{r['fim']['suffix']}[pre]{r['fim']['prefix']}[mid]{r['fim']['middle']}"
        assert r["fim"]["prefix"] + r["fim"]["middle"] + r["fim"]["suffix"] == r["text"]
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            fill_in_middle.Markers(*bad)
    assert fill_in_middle.fim_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fim_by_lines(spark):
    made = fill_in_middle.fill_in_middle(_clash(spark, ["l1\nl2\n\nl4"] * 30), percent=100, units=r"[^\n]*\n|[^\n]+")
    for r in made.collect():
        f = r["fim"]
        assert f["n"] == 4 and f["prefix"] + f["middle"] + f["suffix"] == r["text"]
        assert all(not part or part.endswith("\n") or r["text"].endswith(part) for part in (f["prefix"], f["middle"]))


# token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_tokenizer())


def test_counts_are_the_librarys(spark, tokenizer):
    got = token_counts.token_report(_clash(spark, ODD), queries.byte_tokenizer()).orderBy("doc_id").collect()
    want = [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in ODD]
    assert [r["n_tokens"] for r in got] == want
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in ODD]
    assert [r["over_limit"] for r in got] == [n > 1024 for n in want]
    kept = token_counts.count_tokens(_clash(spark, ODD), queries.byte_tokenizer())
    assert kept.columns == ["doc_id", "text", "__fim", "__tokens", "n", "tokens"]
    assert token_counts.token_report(spark.createDataFrame([], "doc_id long, text string"), queries.byte_tokenizer()).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (40, 8), (100, 20), (64, 64)])
def test_chunks_resynchronise(tokenizer, chunk, overlap):
    """Runs longer than any overlap, cut special tokens, contractions and blanks at every chunk end."""
    model, dice = token_counts.Model.read(queries.byte_tokenizer()), random.Random(chunk)
    assert model.look_ahead == len("<|endoftext|>")
    counter = token_counts.Counter(model, chunk, overlap)
    bits = [" ", "  ", "\n\n ", "a", "Hello", "'s", "'re", "'ll", "<|endoftext|>", "<|endof", "text|>", "é中😀", "1234", "!!?", "\t", "　", "x" * 30, " " * 25, "don't", "'", "\x1c\x1f", "\u0085", "y" * 300]
    for _ in range(600):
        text = "".join(dice.choice(bits) for _ in range(dice.randrange(1, 80)))
        assert counter.batch([text]) == [len(tokenizer.encode(text, add_special_tokens=False))], text


def test_a_long_text_is_cut(spark, tokenizer, monkeypatch):
    text = "".join(f"Line {n}: some words, isn't it?\n" for n in range(20_000)) + "z" * 5000
    model = token_counts.Model.read(queries.byte_tokenizer())
    counter, seen = token_counts.Counter(model), []
    whole = counter.boundaries
    monkeypatch.setattr(counter, "boundaries", lambda t, a, b: seen.append(b - a) or whole(t, a, b))
    assert counter.batch([text, "short"]) == [len(tokenizer.encode(text, add_special_tokens=False)), 1]
    assert len(seen) >= 4 and max(seen) <= counter.chunk + counter.overlap
    got = token_counts.count_tokens(spark.createDataFrame([(text,)] * 2, "text string"), queries.byte_tokenizer()).collect()
    assert [r["tokens"] for r in got] == [len(tokenizer.encode(text, add_special_tokens=False))] * 2


def test_unproven_tokenizers_encode_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = token_counts.Model.read(path)
    assert model.look_ahead is None
    text = "Some Words, again. " * 40
    assert token_counts.Counter(model, 16, 4).batch([text]) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))]


# whitening


def _brute(rows):
    """(ids, n, deviations, whitened, shares) by the covariance's eigenvectors."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    mean = (fit - 1000000).mean(axis=0)
    cov = (fit - 1000000 - mean).T @ (fit - 1000000 - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    white = (x - 1000000 - mean) @ v / np.sqrt(np.maximum(e, 1e-300))
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), white, e / e.sum()


def _check(spark, rows, parts, d, kind="array<float>"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(parts)
    got = sorted(whitening.whitening_report(table).collect(), key=lambda r: (r["vec_id"], r["component"]))
    ids, n, dev, white, shares = _brute(rows)
    k = min(16, d)
    assert [(r["vec_id"], r["component"]) for r in got] == sorted((i, c + 1) for i in ids for c in range(k))
    order = np.argsort(ids, kind="stable")
    w = np.array([r["whitened"] for r in got]).reshape(-1, k)
    sign = np.sign((w * white[order][:, :k]).sum(axis=0))
    assert np.abs(w * sign - white[order][:, :k]).max() < 1e-8
    assert [r["deviation"] for r in got[::k]] == dev[order].tolist()
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got}.pop() < 1e-9
    assert np.allclose([r["explained"] for r in got[:k]], shares[:k], rtol=1e-9)
    return got


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_whitening_against_brute_force(spark, parts):
    dice = np.random.default_rng(parts)
    scale = np.linspace(3, 0.5, 20)
    rows = [(n, [float(c) for c in dice.normal(size=20) * scale]) for n in range(300)]
    rows += [(1000 + n, rows[7][1]) for n in range(150)] + [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19)]
    _check(spark, rows, parts, 20)


def test_whitening_of_few_dimensions_and_equal_rows(spark):
    dice = np.random.default_rng(1)
    vectors = [(n, [float(c) for c in dice.normal(size=3)]) for n in range(40)]
    _check(spark, vectors + [(n + 40, v) for n, v in vectors], 5, 3)
    same = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitening_report(same).count() == 0
    assert whitening.whitening_report(same.where("false")).count() == 0
    assert whitening.whiten(same, None).columns == ["vec_id", "embedding", "white"]


def test_whitening_of_odd_vectors(spark):
    """Other lengths go, entries without a long x go, a deviation beyond a long is null, other columns stay."""
    rows = [(0, [1.0, 0.0], "a", "b"), (1, [0.0, 1.0], "a", "b"), (2, [2.0, 5.0], "a", "b"), (None, [2.0, 5.0], "a", "b"), (3, [1.0], "a", "b"), (4, [1e30, 0.0], "a", "b")]
    schema = "vec_id long, embedding array<double>, __white string, x string"
    table = spark.createDataFrame(rows, schema)
    out = whitening.whiten(table, whitening.fit(table)).collect()
    assert sorted(map(repr, (r["vec_id"] for r in out))) == ["0", "1", "2", "None"] and {(r["__white"], r["x"]) for r in out} == {("a", "b")}
    assert {r["vec_id"]: r["white"]["deviation"] for r in out}[2] == (3 * 128 - 192) ** 2 + (3 * 320 - 384) ** 2
    wide = spark.createDataFrame([(0, [1e14, 0.0], "", ""), (1, [-1e14, 1.0], "", ""), (2, [3.0, 2.0], "", "")], schema)
    got = {r["vec_id"]: r["white"] for r in whitening.whiten(wide, whitening.fit(wide)).collect()}
    assert got[0]["deviation"] is None and got[2]["deviation"] is None or got[2]["deviation"] > 0
    assert all(np.isfinite(w["whitened"]).all() for w in got.values())


def test_states_merge_without_loss():
    dice = np.random.default_rng(2)
    x = (dice.normal(size=(500, 12)) * 50).astype(np.int64) + 1_000_000
    parts = [whitening.State.of(x[a:b]) for a, b in ((0, 3), (3, 200), (200, 201), (201, 500))]
    merged = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    whole = whitening.State.of(x)
    assert merged.sums == whole.sums and merged.n == 500
    assert np.allclose(merged.values, whole.values, rtol=1e-12)
    assert np.allclose(np.abs((merged.vectors * whole.vectors).sum(axis=1)), 1)


@pytest.mark.parametrize("name", ["op11_token_counts", "op12_fill_in_middle", "op13_whitening"])
def test_queries_leave_no_files(spark, name):
    from linkweave.runtime import checkpoint_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    files = lambda: {str(f.getPath()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    before = files()
    assert queries.QUERIES[name](spark, SF).count() >= 200
    assert files() == before
