"""Spelling variants, compression bands and source divergence against brute-force versions and on odd rows."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import compression_bands, source_divergence, spelling_variants

R = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "Straße straße STRASSE strase", "de", None, 1), (5, None, None, "b", 0), (5, "", "", "b", 0), (5, "   \n\t ", "fr", "", 0), (7, "×÷ÀÿĀ☃ word", "en", "a", 3)]


def rows_of(n, vocabulary, length=60):
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, " ".join(R.choices(vocabulary, weights, k=R.randint(0, length))), R.choice(["en", "de", None]), R.choice(["a", "b", "c", "é", None]), 0) for i in range(n)]


def brute_variants(rows, drop=97):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    best = {w: min(links[w], key=lambda x: (-n[x], x)) for w in links}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(links[w]), n[form[w]] if w in form else -1) for w in n)


def shown(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def misspellings():
    words = ["".join(R.choice("abcdeß") for _ in range(R.randint(4, 8))) for _ in range(40)]
    out = list(words)
    for w in words * 4:
        k = R.randrange(len(w))
        out.append(R.choice([w[:k] + w[k + 1 :], w[:k] + R.choice("abcde") + w[k:], w[:k] + R.choice("abé") + w[k + 1 :]]))
    return out


def test_spelling_variants_against_all_pairs(spark):
    rows = [*rows_of(150, misspellings()), *ODD, *ODD[:1] * 3]
    docs = spark.createDataFrame(rows, DOCS)
    assert shown(spelling_variants.spelling_variants(docs)) == brute_variants(rows)
    clashing = docs.withColumns({"word": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "key": F.lit("k")}).repartition(7)
    assert shown(spelling_variants.spelling_variants(clashing, drop=3)) == brute_variants(rows, 3)


def test_long_words_have_variants_too(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "WHOLE", 6)
    rows = rows_of(150, misspellings())
    docs = spark.createDataFrame(rows, DOCS)
    plain, wild = spelling_variants.keys("abbcdefg")
    assert len(plain) == 1 + 7 and len(wild) == 8 and len({*plain, *wild}) == 16
    assert spelling_variants.keys("abcdefgh")[0][3] == spelling_variants.keys("abdefgh")[0][0]
    assert spelling_variants.keys("abcdefg")[0][2] == "acdefg"
    long = "".join(R.choice("ab") for _ in range(20_000))
    assert len({*spelling_variants.keys(long)[1]} & {*spelling_variants.keys(long[:99] + "z" + long[100:])[1]}) == 1
    assert {r.word for r in spelling_variants.spelling_variants(docs).collect()} == {w for w, *_ in brute_variants(rows)}


def test_forms_are_followed_to_their_root(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    texts = [" ".join([w] * (3 * 2**k)) for k, w in enumerate(chain)] + [" ".join(["mmmmm"] * 6 + ["mmmmn"] * 3 + ["mmmmo"] * 3 + ["ammmm"] * 6)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    out = {r.word: r for r in spelling_variants.spelling_variants(docs, drop=None).collect()}
    assert {out[w].root for w in chain} == {"abbbbb"} and out["abbbbb"].form is None
    assert (out["mmmmn"].form, out["mmmmn"].n_near, out["mmmmm"].form) == ("mmmmm", 2, None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert spelling_variants.spelling_variants(docs).count() == 0
    assert source_divergence.source_divergence(docs).count() == 0
    assert compression_bands.compression_quality(docs).count() == 0
    odd = spark.createDataFrame(ODD, DOCS)
    assert spelling_variants.spelling_variants(odd, drop=None).collect() == []


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def in_band(raw, packer):
    limits = [b for b in compression_bands.BANDS if b[0] <= len(raw)]
    return not limits or limits[-1][1] <= len(packer.compress(raw)) / len(raw) <= limits[-1][2]


def brute_kept(text):
    raw, packer = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    if brute_rules(text)[5] or not in_band(raw, packer):
        return False
    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return sum(len(p) for p in parts if not in_band(p, packer)) <= 0.25 * len(raw)


def prose(n):
    syllables = ["the", "on", "er", "wh", "ing", "tion", "da", "re", "é", "st", "mo", "ku", "lé"]
    return " ".join("".join(R.choices(syllables, k=R.randint(1, 4))) for _ in range(n))


def test_compression_bands_against_brute_force(spark):
    import base64

    noise = base64.b64encode(R.randbytes(40_000)).decode()
    spread = " ".join(noise[i : i + 9] for i in range(0, 30_000, 9))
    texts = [None, "", " \n\t", "one two", prose(9), prose(10), prose(300), prose(30_000), "a b c d e " * 50, prose(200) + "\n" + "x y z w v\n" * 3, "a\nb\na\n a\nb\r\n\v\n", spread, noise, prose(900) + " " + spread[:9000], "ab " * 4000, " ".join(f"k{i}" for i in range(3000)), "<b>*#&|%$</b> " * 2 + prose(40), prose(50) * 2]
    texts += [prose(R.randint(1, 80)) for _ in range(60)] + ["a b a b a c", "q " * 7, " ".join(str(i % 7) for i in range(40))]
    rows = [(i % 11, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("old"), "Ratio": F.lit(1), "at": F.monotonically_increasing_id()})
    out = compression_bands.compression_quality(docs.repartition(3)).collect()
    assert len(out) == len(texts) and "Ratio" not in out[0].__fields__
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text), r.text
        assert r.kept == brute_kept(r.text)
    kept = {r.text: r.kept for r in out}
    assert kept[texts[6]] and kept[texts[7]] and not kept[spread] and not kept["ab " * 4000] and not kept[None]


def test_quality_of_a_very_long_text():
    words = [b"w%d" % (i % 70_000) for i in range(140_000)]
    assert compression_bands.repeated_words(words) == 140_000
    assert compression_bands.repeated_words(words[:70_003]) == 0
    assert compression_bands.repeated_words(words[:70_005]) == 10


def brute_divergence(rows, min_docs=10, top=10):
    texts = [("" if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows]
    found = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), a, b) for t, a, b in texts]
    out = []
    for lang in {a for _, a, _ in found}:
        mine = [(w, b) for w, a, b in found if a == lang]
        kept = sorted(w for w, c in Counter(w for ws, _ in mine for w in set(ws)).items() if c >= min_docs)
        groups = {b: Counter(w for ws, x in mine if x == b for w in ws if w in set(kept)) for _, b in mine}
        whole = sum(groups.values(), Counter())

        def share(c, w):
            return 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for a, c in groups.items():
            pairs = [(b, sum(gap(share(c, w), share(d, w)) for w in kept)) for b, d in groups.items() if b != a]
            terms = [(w, gap(share(c, w), share(whole, w))) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return sorted(out)


@pytest.mark.parametrize("heavy, side, cells, block", [(4, 256, 1 << 16, 20_000), (1, 2, 1, 3), (2, 1, 5, 1), (0, 3, 9, 10)])
def test_divergence_against_brute_force(spark, monkeypatch, heavy, side, cells, block):
    monkeypatch.setattr(source_divergence, "CELLS_A_PAIR", 0, raising=False)
    vocabulary = ["".join(R.choice("abcdé") for _ in range(R.randint(1, 4))) for _ in range(90)] + ["Zürich", "ÄÖ", "x" * 500]
    rows = rows_of(220, vocabulary) + ODD * 2 + [(9, "solo " * 4, "xx", s, 0) for s in "abc"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"term": F.lit("t"), "value": F.lit(3), "p": F.lit(0)}).repartition(5)
    out = source_divergence.source_divergence(docs, heavy=heavy, side=side, cells=cells, rows=block)
    assert sorted(tuple(r) for r in out.collect()) == brute_divergence(rows)


def test_counts_are_the_same_when_tasks_send_them_early(spark, monkeypatch):
    rows = rows_of(60, ["ab", "cd", "éé", "Ab"])
    docs = spark.createDataFrame(rows, DOCS).repartition(1)
    want = sorted(tuple(r) for r in source_divergence.term_counts(docs).collect())
    words = sorted(tuple(r) for r in spelling_variants.word_counts(docs, min_chars=1).collect())
    monkeypatch.setattr(source_divergence, "FLUSH_BYTES", 1)
    monkeypatch.setattr(spelling_variants, "FLUSH_WORDS", 1)
    assert sorted(tuple(r) for r in source_divergence.term_counts(docs).collect()) == want
    assert sorted(tuple(r) for r in spelling_variants.word_counts(docs, min_chars=1).collect()) == words


def test_shares_of_very_large_counts_are_exact(spark):
    n, total, kept = 10**17 + 3, 10**18 + 7, 10**9
    got = spark.range(1).select(source_divergence._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
    p, q = pa.array([10**9 + 1, 1]).to_numpy(), pa.array([1, 10**9]).to_numpy()
    assert source_divergence.gap(p, q).tolist() == [(10**9) ** 2 // (10**9 + 2), (10**9 - 1) ** 2 // (10**9 + 1)]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no test tables")
def test_queries_over_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert shown(spelling_variants.op11_spelling_variants(spark, d)) == brute_variants(rows)
    assert sorted(tuple(r) for r in source_divergence.op13_source_divergence(spark, d).collect()) == brute_divergence(rows)
    judged = {r.doc_id: r for r in compression_bands.op12_compression_bands(spark, d).collect()}
    assert len(judged) == len(rows)
    for i, text, *_ in rows:
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(text)
        assert r.kept == brute_kept(text)
