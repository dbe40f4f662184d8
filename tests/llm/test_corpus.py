"""Token counts, source divergence and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlocus.llm import byte_bpe, collocations, divergence, queries, token_counts
from gridlocus.llm.folding import Fold

JSON = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for c in ("key", "term", "phrase", "n", "slot", "item", "a"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- token counts ------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def odd_texts():
    rng = random.Random(7)
    alphabet = [*"''  \n\t sretvlmdaé1٣!?.　 \x1c\x85中ßDS", "'s", "'re", "<|endoftext|>", "<|endoftext", "\U0001fbf0", "Ᲊ", "x" * 60]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return [*texts, None, "", "x" * 60_000, "ab " * 3000, "<|endoftext|>", "<|endoftext|>" * 3, "same", "same"]


def test_token_counts_equal_the_library(spark, library):
    texts = odd_texts()
    rows = [(None if i == 5 else i // 2 * 2, x, "l", "s") for i, x in enumerate(texts)]  # repeated and null keys
    got = token_counts.token_counts(frame(spark, rows), JSON).collect()
    want = Counter((d, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for d, x, _, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_whole <= r.n_pieces for r in got) and any(r.n_whole for r in got)
    assert token_counts.token_counts(frame(spark, rows).limit(0), JSON).count() == 0


def test_whole_tokens_are_those_that_the_library_leaves_in_one(spark, library):
    proof = token_counts.prove_whole(spark, JSON).where("token_id % 17 = 0").collect()
    assert len(proof) > 2500
    for r in proof:
        try:
            text = bytes(r.token).decode()
        except UnicodeDecodeError:
            continue
        if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert r.whole == (library.encode(text, add_special_tokens=False).ids == [r.token_id])


def test_long_pieces_merge_like_short_ones():
    merges = token_counts.merges_from(JSON)
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("theandion ") for _ in range(rng.randint(2, 40))).encode()
        assert merges._long(piece) == merges._short(piece)


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.merges_from(public_tokenizers.path("word_bpe_49k.json"))


def test_token_count_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        d: (len(x.encode()), n := len(library.encode(x, add_special_tokens=False).ids), n > 512) for d, x in texts.items()}


def test_token_queries(spark, library):
    """Digests, starts and end ids of the token file query, and those of the rank query, by the libraries."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    start, want = 0, {}
    for d in sorted(texts):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[d] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_codes(spark, SMALL).collect()} == want
    ranks = byte_bpe.ranks_from(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in queries.op3_byte_bpe(spark, SMALL).collect():
        ids = np.array(plain.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(texts[r.doc_id].encode()))


# ---- folding -----------------------------------------------------------------
@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_folds_and_their_spills_add_up(limit):
    rng = random.Random(limit)
    want, got, held = Counter(), Counter(), Fold(["a", "b"], ["n"], limit)
    bounded, total = Fold(["a", "b"], ["n"], limit, spills=False), Counter()
    take = lambda into, t: into.update({(a, b): n for a, b, n in zip(*[t[c].to_pylist() for c in "abn"])})
    for _ in range(40):
        rows = [(rng.choice("xyz"), rng.randint(0, 6), rng.randint(1, 3)) for _ in range(rng.randint(1, 9))]
        for a, b, n in rows:
            want[a, b] += n
        table = pa.table({c: list(x) for c, x in zip("abn", zip(*rows))})
        for full in held.add(table):
            take(got, full)
        assert not list(bounded.add(table))
    for fold, into in ((held, got), (bounded, total)):
        for full in fold.rest():
            take(into, full)
    assert got == want == total


# ---- divergence --------------------------------------------------------------
def share(count, total, kept):
    return 1 + 1_000_000_000 * (count + 5) // (total + 5 * kept)


def divergences(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")))
        for term, n in found.items():
            counts[lang, term][source] += n
            docs[lang, term] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        total = {s: sum(counts[lang, t][s] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, t][s], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, t].values()), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, t][s] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def spoken(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéßZQ中") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "1", "-", "_", ". "]) for _ in range(rng.randint(0, 25)))
        rows.append((i // 2, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "é", None])))
    return [*rows, (1, None, "en", "s9"), (2, "", "xx", "one"), (3, " 1 2", "xx", "two"), (4, "alone", "yy", "only"), (5, "w " * 50_000, "en", "s2")]


@pytest.mark.parametrize("min_docs,top", [(8, 5), (1, 50), (10_000, 50)])
def test_divergence_equals_plain_version(spark, min_docs, top):
    rows = spoken(300, min_docs)
    got = divergence.source_divergence(frame(spark, rows), min_docs, top).collect()
    want = divergences(rows, min_docs, top)
    assert len(got) == len(want) and {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == want
    assert divergence.source_divergence(frame(spark, rows).limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    totals = [rng.randint(1, 9_000_000_000_000_000) for _ in range(2000)] + [1, 5, 9_000_000_000_000_000]
    counts = [rng.randint(0, t) - 5 for t in totals]
    got = divergence.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 1_000_000_000 * (c + 5) // t for c, t in zip(counts, totals)]
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), np.array([10**16]))


def test_stripes_are_whole_terms():
    counted = divergence.slice_counts(pa.array(["en", "en", None]), pa.array(["a", "b", "a"]), pa.array(["x X y", "x", None]))
    rows = [r for batch in divergence.stripes_of(counted) for r in batch.to_pylist()]
    assert {(r["lang"], r["term"]): {(e["source"], e["n"], e["docs"]) for e in r["stripe"]} for r in rows} == {
        ("en", b"x"): {("a", 2, 1), ("b", 1, 1)}, ("en", b"y"): {("a", 1, 1)}, ("en", b""): {("a", 0, 1), ("b", 0, 1)}, ("", b""): {("a", 0, 1)}}


# ---- collocations ------------------------------------------------------------
def plain_collocations(rows, threshold, covered, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= threshold}
        cover = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    cover[g[i : i + k]] = max(cover[g[i : i + k]], a)
        best = []
        for g, a in candidates.items():
            if 100 * cover[g] >= covered * a:
                continue
            cuts = [(2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            best.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def chatter(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "a", "of", "new", "york", "City", "x", "é", "中", "ÄÖ", "zz9", "-"]
    rows = []
    for i in range(n):
        parts = [rng.choice(["new york city", "of the", "New York", rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ; "]) for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(parts), rng.choice(["en", "en", "en", "de", None, ""]), "s"))
    return [*rows, (1, None, "en", "s"), (2, "", None, "s"), (3, "one", "xx", "s"), (3, "one", "xx", "s"), (4, "a b " * 40_000, "de", "s")]


@pytest.mark.parametrize("threshold,covered,top", [(30, 80, 2000), (5, 50, 20), (2, 101, 2000)])
def test_collocations_equal_plain_version(spark, threshold, covered, top):
    rows = chatter(250, threshold)
    got = collocations.collocations(frame(spark, rows), threshold, covered=covered, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(rows, threshold, covered, top))
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [1, 3, 20, 500])
def test_merged_summaries_keep_every_frequent_key(capacity):
    rng = np.random.default_rng(capacity)
    keys = rng.zipf(1.4, 30_000) % 5000
    summary, true = collocations.Summary(capacity), Counter(keys.tolist())
    for part in np.array_split(keys, 60):
        k, c = np.unique(part, return_counts=True)
        summary.merge(k.astype(np.uint32), c)
        summary.settle()
        assert len(summary.keys) <= capacity
    threshold = len(keys) // (capacity + 1) + 1
    assert summary.error <= len(keys) // (capacity + 1)
    assert {k for k, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())
    counted = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert all(true[k] - summary.error <= counted.get(k, 0) <= true[k] for k in true)


def test_capacity_exceeds_mass_over_threshold():
    for mass in (0, 1, 29, 30, 31, 10**9):
        assert collocations.capacity_for(mass, 30) > mass / 30
