"""Each operator against a brute-force version, and on nulls, empty and repeated rows, and clashing names."""

import hashlib
import itertools
import json
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_stream, chat_format, common, components, embedding_dedup, ngram_join, shingles, source_mixing, substring_dedup, tiff_pages, token_output, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("etaoinsr") for _ in range(R.randint(2, 7))) for _ in range(900)]


def words(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_url_rules(spark):
    urls = ["http://Example.com/en/7?x", "http://a.com/en/1", "http://b.net/de/80", "http://www.example.net/de/80", "http://notexample.net/de/8", "http://o.org/es", "no url", None, "", "x://h?/en/", "http://a.b.com#/en/"]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    urls += ["http://x.org/es/" + "a" * 100_000, urls[0]]
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labelled = url_filter.labelled_urls()
    out = {r.page_id: r for r in url_filter.filter_urls(pages, labelled).collect()}
    assert [out[i].rule for i in range(5)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/"]
    assert [out[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "allow"]
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path) == (url_filter.split_url(u or ""))
    assert url_filter.filter_urls(pages.limit(0), labelled).count() == 0


def test_url_model_separates_unseen_paths():
    labelled = url_filter.labelled_urls()
    w = url_filter.train([url_filter.split_url(u) for u, _ in labelled], [y for _, y in labelled])
    z = lambda u: url_filter.logits(w, [url_filter.ngram_features(*url_filter.split_url(u))])[0]
    assert z("http://www.spam-farm.example.com/fr/991") > 0 > z("http://blog.museum.example.com/fr/991")


def test_logits_equal_sums_one_by_one():
    w = np.random.default_rng(1).standard_normal(url_filter.FEATURES + 1)
    grams = [url_filter.ngram_features(*url_filter.split_url(u)) for u, _ in url_filter.labelled_urls()] + [url_filter.ngram_features("", "")]
    assert np.allclose(url_filter.logits(w, grams), [(w[g].sum() + w[-1]) / np.sqrt(len(g) + 1) for g in grams])


def test_packed_ids_round_trip():
    for bits in (1, 5, 13, 16, 17):
        ids = np.array([R.randrange(1 << bits) for _ in range(9000)], np.uint32)
        chunk = token_output.Chunk(memoryview(token_output.pack_chunk(3, 7, [1, None, 9], [ids[:10], ids[10:10], ids[10:]], bits)))
        assert (chunk.part, chunk.before, chunk.docs) == (3, 7, [1, None, 9])
        assert (chunk.document(0) == ids[:10]).all() and len(chunk.document(1)) == 0 and (chunk.document(2) == ids[10:]).all()
        assert (chunk.read(4090, 4100) == ids[4090:4100]).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Hello there", None, "", "<|endoftext|>x  y\tz", words(3000), "É\u2003a", "it's 42!"]
    path = f"file://{tmp_path}/t"
    token_output.write_token_files(documents(spark, texts).orderBy("n_chars"), path, P.path("word_bpe_49k.json"), 2, 49_408)
    base = {r.part: r.base for r in token_output.part_starts(spark, path).collect()}
    library, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r in sorted(token_output.read_token_files(spark, path).collect(), key=lambda r: r.doc_id):
        want = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start + base[r.part] == at
        at += len(want)


def test_word_encoder_equals_the_library():
    encoder = token_output.WordEncoder(P.path("word_bpe_49k.json"))
    odd = ["İstanbul", "don't", "it's.", "Ab,", "Ab..", "ſ", "ªº", "naïve!", "Straße.", "a1b", ",", "word—", "É", "İ.", "x" * 100, "s's", "Ǆ", "ŉ", "日本.", "e\u0301a", "<|endoftext|>", "t,"]
    texts = [" ".join(R.choice(odd + VOCABULARY) + R.choice(["", "", ".", ","]) for _ in range(300)) for _ in range(30)] + ["", "\n \n", "a\tb\u2003c"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder.LIMIT = 0
    assert [x.tolist() for x in encoder.encode(texts)] == [x.tolist() for x in token_output.WordEncoder(P.path("word_bpe_49k.json")).encode(texts)]


def test_distinct_words_are_looked_up_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            self.looked += 1
            return super().get(key, default)

    encoder = token_output.WordEncoder(P.path("word_bpe_49k.json"))
    encoder.known = Counted(encoder.known)
    texts = ["skipped", None, "", "again and again, " * 400 + "\n once\n\nÀgain.  İn <|endoftext|>"]
    found = encoder.encode(pa.array(texts).slice(1))
    assert [x.tolist() for x in found] == [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    assert encoder.known.looked < 40 and encoder.encode([]) == encoder.encode(pa.array([], pa.string())) == []


def test_forms_of_a_word_are_encoded_once():
    encoder = token_output.WordEncoder(P.path("word_bpe_49k.json"))
    text = "again Again AGAIN, again... aGain!!! Again$$$ (again) agàin"
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(encoder.known) == {"", "again", "agàin", ",", "...", "!!!", "$$$", "(again)"}


def test_word_encoder_equals_the_library_on_marks_and_other_settings(tmp_path):
    own = random.Random(7)
    odd = ["\u212a", "\u212bb", "ẞ", "\u1e9ea", "Ȿ", "H\u0331", "t\u0308", "Ⱥ" * 40, "x" * 64, "İ", "ΑΣ", "ǅ", "a'", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "7", "\u0345", "\u200d", "ø"]
    marks = ["", "", ".", "..", "?!", "$$$", "'", "'s.", "<", ">|", "\\", "]^-", "\u0301", "*" * 70, "…"]
    texts = ["".join(own.choice(odd + VOCABULARY) + own.choice(marks) + own.choice([" ", " ", "\n", "", "\t", "\u00a0"]) for _ in range(300)) for _ in range(40)]
    settings = json.loads(Path(P.path("word_bpe_49k.json")).read_text())
    kinds = {"same": {}, "cased": {"normalizer": {"type": "NFC"}}, "added": {"added_tokens": [*settings["added_tokens"], settings["added_tokens"][0] | {"id": 320, "content": "a"}]}}
    for kind, other in kinds.items():
        (tmp_path / kind).write_text(json.dumps(settings | other))
        encoder = token_output.WordEncoder(str(tmp_path / kind))
        assert encoder.splits == (kind == "same")
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(5, "b", 0), (None, "x", 0), (5, "a b", 0), (2, None, 0)], "doc_id long, text string, ids int")
    for name, docs in (("some", rows), ("none", rows.limit(0))):
        path = f"file://{tmp_path}/{name}"
        token_output.write_token_files(docs, path, P.path("word_bpe_49k.json"), 2, 49_408)
        found = token_output.read_token_files(spark, path).join(token_output.part_starts(spark, path), "part").collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in found) == ([("2", 1), ("5", 2), ("5", 3), ("None", 2)] if name == "some" else [])
        starts = sorted((r.start + r.base, r.n_tokens) for r in found)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def brute_components(texts, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def near_copies(n, size):
    base = words(size).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(R.randint(0, 4)):
            copy[R.randrange(size)] = R.choice(VOCABULARY)
        out.append(" ".join(copy))
    return out


def test_ngram_join_equals_brute_force(spark):
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "É a", "é a", *near_copies(60, 120), *near_copies(20, 30), *[words(80) for _ in range(20)]]
    texts += texts[9:15] + [words(60) + " " + texts[9]]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts)
    assert ngram_join.ngram_jaccard_join(empty(spark)).count() == 0


def test_prefix_signatures_lose_no_pair():
    for _ in range(300):
        n = R.randint(1, 40)
        x = np.unique(np.array([R.randrange(200) for _ in range(n)], np.uint64))
        y = np.array(sorted(set(x.tolist()) ^ {R.randrange(200) for _ in range(R.randint(0, 4))}), np.uint64)
        kind = lambda a: (a % np.uint64(3) + np.uint64(1)).astype(np.uint8)
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both) and x.tolist() != y.tolist():
            mine, theirs = (np.intersect1d(x, y) if k else a for k, a in ((0, x), (0, y)))
            assert set(ngram_join.prefix_signatures(mine, kind(mine), 0).tolist()) & set(ngram_join.prefix_signatures(theirs, kind(theirs), 0).tolist())
            shared = np.intersect1d(x, y)
            assert set(ngram_join.prefix_signatures(shared, kind(shared), len(x) - both).tolist()) & set(ngram_join.prefix_signatures(shared, kind(shared), len(y) - both).tolist())


def test_ngram_join_with_all_classes_and_small_packs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CLASS_ENDS", (2, 3, 6))
    monkeypatch.setattr(ngram_join, "PACK", 900)
    common = words(40)
    texts = [*near_copies(30, 60), *[f"{common} {words(8)}" for _ in range(25)], *near_copies(12, 25), *[words(30) for _ in range(10)]] * 2
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents(spark, texts).repartition(5)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts)


def test_ngram_join_of_odd_rows(spark):
    long = words(30_000)
    rows = [(None, long, "x"), (5, long + " end", "x"), (5, words(20), "y"), (7, long, None), (7, long, None), (None, None, None)]
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect())
    assert out == sorted([("None", 29_996, 5), ("5", 29_997, 5), ("5", 16, 5), ("7", 29_996, 5), ("7", 29_996, 5), ("None", 0, None)])


def test_marks_lose_no_row(spark):
    rows = lambda a, b: spark.range(a, b).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"), (F.col("id") * 3).alias("words"))
    held, others = rows(0, 3000), rows(3000, 9000)
    marks = common.Marks(held, "x", "words")
    assert marks.maybe(held, held["x"], held["words"]).count() == 3000 and marks.surely_not(held, held["x"], held["words"]).count() == 0
    few = marks.maybe(others, others["x"], others["words"]).count()
    assert few < 6000 // 8 and marks.surely_not(others, others["x"], others["words"]).count() == 6000 - few
    none = common.Marks(held.limit(0), "x", "words")
    assert none.maybe(held, held["x"], held["words"]).count() == 0 and none.surely_not(held, held["x"], held["words"]).columns == ["x", "words"]


def test_ngram_join_reads_a_repeated_text_once(spark, monkeypatch, tmp_path):
    packed = []

    def written(df, name, put=ngram_join.materialize):
        out = put(df, name)
        if name == "found":
            packed.append(out.where("docs is not null").select(F.inline("docs")).count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", written)
    texts = [*near_copies(10, 60), *[words(40) for _ in range(10)], "", None] * 6
    documents(spark, texts).repartition(6, "doc_id").write.parquet(f"{tmp_path}/docs")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    assert [out[i] for i in range(len(texts))] == [(n, k if n else i) for i, (n, k) in enumerate(brute_components(texts))]
    assert packed[0] <= 24


def test_blocks_of_a_group_lose_no_link(monkeypatch):
    texts = near_copies(90, 80) + near_copies(10, 80)
    sets = [np.unique(shingles.positions(shingles.words_of(t))) for t in texts]
    rows = [(i, len(x), x.tobytes()) for i, x in enumerate(sets)]
    for one, two in ((rows, None), (rows[:40], rows[40:])):
        left = components.Members(one)
        edges = components.block_links(left, left if two is None else components.Members(two), 80)
        if two is not None:
            right = components.Members(two)
            edges += components.block_links(left, left, 80) + components.block_links(right, right, 80)
        root = list(range(len(texts)))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        assert [r for _, r in brute_components(texts)] == root


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    out = {r.id: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_shingles_of_long_texts():
    long = words(120_000).split()
    whole = shingles.positions(shingles.words_of(" ".join(long)))
    assert len(whole) == len(long) - 4
    at = 50_000 - 2
    assert whole[at] == shingles.positions([w.encode() for w in long[at : at + 5]])[0]


def test_substring_dedup(spark):
    passage, other = ". ".join(words(9) for _ in range(7)) + ".", words(70)
    texts = [words(60) + ". " + passage + " " + words(60), words(30) + ". " + passage + " " + words(40), words(50) + "\n" + other + "\n" + words(10), words(40) + "\n" + other, words(200), words(200), None, "", "short line"]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark, texts).withColumnRenamed("lang", "kept_in")).collect()}
    assert [out[i].text for i in (0, 2, 4, 5, 6, 7, 8)] == [texts[i] for i in (0, 2, 4, 5, 6, 7, 8)]
    for i, gone, keeper in ((1, passage, 0), (3, other, 2)):
        assert gone not in out[i].text and out[i].kept_in == [keeper] and out[i].removed_words >= 40
        assert len(set(out[i].text.split()) & set(texts[i].replace(gone, "").split())) > 20
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    assert substring_dedup.tune_bands(0.8)[0] * 3 >= 21


def test_substring_dedup_inside_lines(spark):
    sizes = [51, 55, 60, 70, 80, 100] * 25
    passages = [words(n) for n in sizes]
    texts = [f"{words(40)} {p} {words(40)}" for p in passages]
    texts += [f"{words(35)} {p} {words(45)}" for p in passages]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark, texts)).collect()}
    gone = 0
    for i, n in enumerate(sizes):
        assert out[i].text == texts[i] and out[len(sizes) + i].kept_in == [i]
        gone += out[len(sizes) + i].removed_words
        assert substring_dedup.MIN_WORDS <= out[len(sizes) + i].removed_words <= n
    assert gone > 0.85 * sum(sizes)


def test_substring_dedup_keeps_every_passage_somewhere(spark):
    """Against brute force: long shared runs go from later documents, what goes stays in another, and other texts stay."""
    passages = [words(R.randint(51, 120)) for _ in range(12)]
    lines = near_copies(8, 90)
    texts = []
    for i in range(90):
        parts = [words(R.randint(5, 60)) for _ in range(3)] + R.sample(passages, R.choice((0, 0, 1, 2))) + ([R.choice(lines)] if i % 5 == 0 else [])
        R.shuffle(parts)
        texts.append(R.choice((" ", "\n")).join(parts))
    texts += texts[:6] + [words(4000) + " " + passages[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (3, texts[3], "y")]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, removed_words string")).collect()
    assert len(out) == len(rows) and sum(r.doc_id == 3 for r in out) == 2 and [r.text for r in out if r.doc_id is None] == [texts[0]]
    now = {r.doc_id: r for r in out}
    grams = lambda t: set(zip(*[t.split()[k:] for k in range(5)], strict=False))
    kept = set().union(*(grams(now[i].text) for i in range(len(texts))))
    for i, text in enumerate(texts):
        earlier = [p for p in passages if p in text and any(p in t for t in texts[:i])]
        assert not any(p in now[i].text for p in earlier)
        if not now[i].removed_words:
            assert now[i].text == text and now[i].kept_in == []
        else:
            assert all(k < i for k in now[i].kept_in) and now[i].removed_words >= substring_dedup.MIN_WORDS
        copied = any(line in text for line in lines)
        went = grams(text) - grams(now[i].text) - kept
        assert copied or len(went) <= 8 * max(1, len(now[i].removed_spans))  # shingles across a cut's ends
        own = grams(text) - set().union(*(grams(t) for k, t in enumerate(texts) if k != i))
        if not copied:
            assert len(own - grams(now[i].text)) <= 8 * len(now[i].removed_spans)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = [*(centres[rng.integers(40, size=300)] + rng.standard_normal((300, 16)) * 0.12), *np.tile(centres[0], (30, 1))]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0, 0.0], 1), (905, [], 1)]
    out = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    found = sum(out[i].n_links for i in range(len(x)))
    assert found >= 0.99 * (near.sum() - len(x))
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i in range(900, 906))
    assert all(out[i].n_links <= near[i].sum() - 1 for i in range(len(x)))


def test_embeddings_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.01]), (4, [2.0, 0.02]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1e-300, 0.0])]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))).collect()}
    smallest = min(np.array(v).tobytes() for i, v in rows if i == 1) == np.array([1.0, 0.0]).tobytes()
    ids = [1, 2, 3, 4, 8] if smallest else [2, 3, 4, 8]
    assert all(out[i] == (len(ids) - 1, ids[0], i == ids[0]) for i in ids)
    assert out[7] == (0, 7, True) and out[None] == (0, None, False)
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("bits", [0, 1])
def test_embeddings_find_lone_pairs_in_a_crowd(spark, monkeypatch, bits):
    if bits:
        monkeypatch.setattr(embedding_dedup, "SENT", 20)
        monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    rng, unit = np.random.default_rng(6), lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, n, pairs = unit(rng.standard_normal(64)), 5000, 400
    x = unit(rng.standard_normal((n, 64)))
    x[: n // 2] = unit(np.sqrt(0.7) * centre + np.sqrt(0.3) * x[: n // 2])
    side = rng.standard_normal((pairs, 64))
    side = unit(side - (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    rows = [*x, *(0.901 * x[:pairs] + np.sqrt(1 - 0.901**2) * side), x[n - 1], x[n - 1]]
    assert (embedding_dedup.plan(len(rows))[0] > 0) == bool(bits)
    out = {r.vec_id: r.component_id for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    assert sum(out[n + i] == out[i] for i in range(pairs)) >= pairs - bits
    assert out[n + pairs] == out[n + pairs + 1] == n - 1 and len(set(out.values())) <= n + bits


def test_tiff_round_trips():
    rng = np.random.default_rng(0)
    for how, predictor, (tile, strip), kind, order in itertools.product((1, 5, 8, 32773), (1, 2), ((0, 0), (0, 7), (16, 0)), (np.uint8, np.uint16), "<>"):
        pages = [rng.integers(0, 7, (37, 53)).astype(kind), np.repeat(rng.integers(0, 200, (50, 3)), 40, axis=1).astype(kind)]
        for k, page in enumerate(tiff_pages.pages_of(tiff_pages.write_tiff(pages, how, predictor, tile, strip, order))):
            assert page[6] is None and page[5] == pages[k].astype(np.dtype(kind).newbyteorder(order)).tobytes()


def test_tiff_pages_of_bad_files(spark):
    good = tiff_pages.write_tiff([np.zeros((2, 2), np.uint8)] * 2)
    rows = spark.createDataFrame([(1, good, 9), (2, b"nonsense", 9), (3, None, 9), (4, good[:20], 9), (5, b"", 9)], "id int, image binary, page int")
    out = tiff_pages.tiff_pages(rows).collect()
    assert sorted((r.id, r.page, r.error is None) for r in out) == [(1, 0, True), (1, 1, True), (2, 0, False), (4, 0, False), (5, 0, False)]


def test_tiff_pages_of_any_bytes():
    rng = np.random.default_rng(3)
    files = [tiff_pages.write_tiff([rng.integers(0, 9, (40, 30)).astype(k)] * 2, how, 2 if how != 32773 else 1, tile, 9) for how in (1, 5, 8, 32773) for k in (np.uint8, np.uint16) for tile in (0, 16)]
    for data in files:
        for _ in range(120):
            bad = bytearray(data)
            for _ in range(R.randint(1, 4)):
                bad[R.choice((R.randrange(len(bad)), len(bad) - 1 - R.randrange(min(180, len(bad)))))] = R.choice((0, 1, 255, R.randrange(256)))
            rows = list(tiff_pages.pages_of(bytes(bad[: R.choice((len(bad), R.randrange(len(bad))))])))
            assert rows and all((r[6] is None) == (r[5] is not None) for r in rows)


def tiff_by_hand(order, big, tags, data):
    """A file of one page, written without the module's writer; ``tags`` hold (tag, type, value)."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16 + len(data)) if big else struct.pack(order + "HI", 42, 8 + len(data)))
    start = len(head)
    rows = struct.pack(order + ("Q" if big else "H"), len(tags))
    for tag, kind, value in sorted(tags):
        value = start if value == "data" else value
        form = {3: "H", 4: "I"}[kind]
        rows += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, 1) + struct.pack(order + form, value).ljust(8 if big else 4, b"\0")
    return head + data + rows + struct.pack(order + ("Q" if big else "I"), 0)


def test_tiff_files_of_other_writers():
    for order, big in itertools.product("<>", (False, True)):
        size = lambda w, h, bits, n, how=1, **more: [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, how), (273, 4, "data"), (277, 3, 1), (278, 4, h), (279, 4, n), *more.get("tags", [])]
        one = next(iter(tiff_pages.pages_of(tiff_by_hand(order, big, size(10, 2, 1, 4), bytes([0b10100000, 0b01000000, 0b11111111, 0b11000000])))))
        assert one[6] is None and list(one[5]) == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1] + [1] * 10
        four = next(iter(tiff_pages.pages_of(tiff_by_hand(order, big, size(3, 1, 4, 2), b"\x12\x30"))))
        assert list(four[5]) == [1, 2, 3]
        values = np.array([[1.5, -2.25, 1e10, 0.0]], f"{order}f4")
        planes = np.frombuffer(values.astype(">f4").tobytes(), np.uint8).reshape(4, 4).T.ravel()
        coded = np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        deep = next(iter(tiff_pages.pages_of(tiff_by_hand(order, big, size(4, 1, 32, 16, tags=[(317, 3, 3), (339, 3, 3)]), coded))))
        assert deep[6] is None and deep[5] == values.tobytes()


def test_restore_finds_the_best_path():
    counts = np.ones(28**3, np.int64)
    for w in ["idiot", "loser", "moron", "trash"] * 30:
        k = [27, 27, *[ord(c) - 97 for c in w], 27]
        for a, b, c in zip(k, k[1:], k[2:]):
            counts[(a * 28 + b) * 28 + c] += 1
    model = toxicity.language_model(counts)

    def score(letters):
        a = b = toxicity.EDGE
        total = 0.0
        for c in letters:
            k = toxicity._kind(c)
            total += model[a, b, k]
            a, b = b, k
        return total + model[a, b, toxicity.EDGE]

    for word in ("1d10t", "l00s3r", "m.o.r", "tt1", "a44b", "$0"):
        paths = [("".join(x for x, _ in path), sum(p for _, p in path)) for path in itertools.product(*toxicity.lattice(word))]
        best = max(p + score(letters) for letters, p in paths)
        found = toxicity.restore(word, model)
        assert any(letters == found and abs(p + score(letters) - best) < 1e-4 for letters, p in paths)


def test_restore():
    counts = np.ones(28**3, np.int64)
    for w in ["idiot", "moron", "loser", "house", "trash"] * 50:
        k = [27, 27, *[ord(c) - 97 for c in w], 27]
        for a, b, c in zip(k, k[1:], k[2:]):
            counts[(a * 28 + b) * 28 + c] += 1
    model = toxicity.language_model(counts)
    for written, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("looooser", "loser"), ("tr@$h", "trash"), ("l o s e r", "loser")):
        assert toxicity.restore(written, model) == meant
    restorer = toxicity.Restorer(model)
    assert {"idiot", "house"} <= restorer.of("1D1OT! i d i o t hooouse")
    assert restorer.of("") == set()


def test_restore_finds_word_borders_at_any_length():
    counts = np.ones(28**3, np.int64)
    for w in ["a", "y", "such", "idiot", "loser", "house", "trash"] * 50:
        k = [27, *[ord(c) - 97 for c in w], 27]
        for a, b, c in zip([27, *k], k, k[1:]):
            counts[(a * 28 + b) * 28 + c] += 1
    restorer = toxicity.Restorer(toxicity.language_model(counts))
    assert "loser" in restorer.of("such a l o s e r")
    assert {"loser", "idiot"} <= restorer.of("y l o s e r y i d i o t")
    for n in range(12, 30):
        assert "loser" in restorer.of(" ".join("house" * n)[: 2 * n] + "a l o s e r")
    assert "loser" in restorer.of("l" + "o" * 60 + "ser") and not any(len(w) > toxicity.LONGEST for w in restorer.known)
    assert {"idiot", "loser"} <= restorer.of("such.a.house.such.a.trash.such.a.1d10t.such.a.l0s3r")
    assert "loser" in restorer.of(" ".join("house" * 2000) + " l o s e r")


def test_toxicity(spark):
    texts = [words(40) + (" stupid idiot" if i % 3 == 0 else "") for i in range(120)] + [None, "", words(20) + " stup1d 1d10t"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    fitted = toxicity.fit(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, fitted).collect()}
    assert min(out[i] for i in range(0, 120, 3)) > 0.3 > max(out[i] for i in (*range(1, 120, 3), 120, 121))
    assert out[122] > 0.3
    none = toxicity.fit(docs, labels.limit(0))
    assert max(r.score for r in toxicity.score_toxicity(docs, none).collect()) < 0.3
    assert toxicity.score_toxicity(empty(spark), fitted).count() == 0


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<<|", "<", None, "", "é\n<|im_end|>\n", "|>"]
    rows = [(c, t, r, said[(c + t) % len(said)], 0) for c in range(5) for t, r in enumerate(("system", "user", "assistant", "<|od\\d\n", None))]
    turns = spark.createDataFrame([*rows, (None, 0, "assistant", "x", 1), rows[0]], "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chat(turns)).collect()}
    for conv in range(5):
        own = [(r or "", x or "") for c, _, r, x, _ in rows if c == conv]
        own = own[:1] + own if conv == 0 else own
        masked = "".join(x for r, x in own if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (out[conv].n_turns, out[conv].turns_sha256, out[conv].loss_sha256) == (len(own), want, hashlib.sha256(masked.encode()).hexdigest())
    assert out[None].loss_chars == 1
    assert chat_format.chat_digests(chat_format.format_chat(turns.limit(0))).count() == 0


def test_chat_of_long_texts(spark):
    long = "<|x é" * 300_000
    data, offsets, first, last = chat_format.assemble(["user", "assistant"], [long, "y" * 5000])
    assert data.tobytes().decode() == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\n{'y' * 5000}<|im_end|>\n"
    assert data[first[1] : last[1]].tobytes() == b"y" * 5000 and offsets[-1] == len(data)
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat_format.chat_digests(chat_format.format_chat(turns)).first().loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_mixing(spark):
    docs = documents(spark, [words(R.randint(1, 60)) for _ in range(400)] + [None, ""])
    rows = source_mixing.mix_sources(docs.withColumnRenamed("lang", "size")).collect()
    by = {}
    for r in rows:
        assert r.copies <= 2 and r.target <= 2 * r.source_size + 1e-6
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.size * r.copies
    assert abs(sum(v[0] for v in by.values()) - 1.5 * sum(v[2] for v in by.values())) < 1e-6
    assert all(abs(t - taken) < 0.15 * t for t, taken, _ in by.values())
    again = source_mixing.mix_sources(docs.withColumnRenamed("lang", "size")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert source_mixing.mix_sources(empty(spark)).count() == 0
    mixed = source_mixing.repeat_documents(source_mixing.mix_sources(docs))
    assert mixed.count() == sum(r.copies for r in rows)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library, merges = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe_stream.Merges(P.path("byte_bpe_50k.json"))
    encoder, decoder = bpe_stream.Encoder(merges), bpe_stream.Decoder(merges)
    encoder.WINDOW = 16
    bits = ["a", "b", " ", "  ", "\n", "é", "'s", "1", "<|endoftext|>", "!", "🙂", "\x1c", "\x85", "the", "x" * 50, "\t"]
    for text in [*("".join(R.choice(bits) for _ in range(R.randint(0, 60))) for _ in range(500)), "ab" * 9000, " " * 9000 + "x", "ing" * 5000, words(30_000)]:
        encoder.known.clear()
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == text == library.decode(ids.tolist(), skip_special_tokens=False)
    broken = [merges.ids[b"\xc3"], merges.ids[b"a"], merges.ids[b"\xf0"]]
    assert decoder.decode(broken) == library.decode(broken, skip_special_tokens=False)
    docs = documents(spark, [None, "", "one two"]).withColumnRenamed("lang", "ids")
    out = bpe_stream.bpe_decode(bpe_stream.bpe_encode(docs, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.decoded for r in out.collect()} == {0: "", 1: "", 2: "one two"}


def test_pipeline_stages(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    texts = [words(60) for _ in range(30)] + [None, ""]
    docs = documents(spark, [*texts, texts[0], texts[1]])
    again = spark.createDataFrame([(3, texts[3], "fr", None, 0), (4, words(60), "fr", None, 0)], DOCS)
    corpus.without_near_copies(spark, docs.union(again), "").write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert sorted(r.doc_id for r in one.collect()) == sorted([*range(32), 4]) and one.columns == docs.columns
    one = one.where("lang = 'en' or doc_id = 3")
    assert corpus.without_repeated_passages(spark, one, "").count() == 32
    assert corpus.mixed(spark, docs, "").columns == docs.columns
    assert corpus.encoded(spark, docs, "").count() == 34


def test_near_copies_are_dropped_without_a_shuffle_of_all_texts(spark, monkeypatch):
    corpus = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(common, "SMALL", 0)
    named = []
    monkeypatch.setattr(common.Marks, "maybe", lambda self, df, *columns, of=common.Marks.maybe: named.append(of(self, df, *columns)) or named[-1])
    texts = [words(40) for _ in range(100)] + [None, ""]
    docs = documents(spark, [*texts, *texts[:20]])
    assert sorted(r.doc_id for r in corpus.without_near_copies(spark, docs.union(docs.limit(3)), "").collect()) == list(range(102))
    assert len(named) == 2 and named[1].count() <= 30


def test_queries_of_the_text_tables(spark):
    """The registered queries on the smallest tables, against the tokenizers library and plain Python."""
    from tokenizers import Tokenizer

    from tessera.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = {name: QUERIES[name](spark, d).collect() for name in ("op2_token_bits", "op6_tiff_pages", "op10_bpe_stream", "op3_substring_dedup", "op9_source_mixing", "op7_toxicity")}
    assert all(sorted(r.doc_id for r in rows) == sorted(docs) for rows in out.values())
    words, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for library in (words, pieces):
        library.no_truncation(), library.no_padding()
    at = 0
    for r in sorted(out["op2_token_bits"], key=lambda r: r.doc_id):
        ids = np.array([*words.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for r in out["op10_bpe_stream"]:
        ids = pieces.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(pieces.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in out["op6_tiff_pages"]:
        data = docs[r.doc_id].encode()
        padded = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out["op7_toxicity"])
    urls = QUERIES["op1_url_filter"](spark, d).collect()
    assert len(urls) == spark.read.parquet(f"{d}/pages.parquet").count() and all(r.verdict in ("allow", "block") for r in urls)
    assert QUERIES["op4_embedding_dedup"](spark, d).count() == spark.read.parquet(f"{d}/embeddings.parquet").count()


def test_pipeline_on_the_smallest_tables(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus.run(spark, d)
    assert out.count() > docs.count() / 2 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    fitted = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score_toxicity(docs, fitted).where("score < 0.3").collect()}
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert kept <= clean
    assert {r.doc_id for r in corpus.without_toxic(spark, docs, d).collect()} == clean
