"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import edits, groups_by_jaccard, plain_words, removed_words, sha, statistics, words
from pyspark.sql import functions as F

from gridlocus.llm import byte_bpe, decontaminate, jaccard, quality, substring, token_codes, toxicity
from gridlocus.llm.store import stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n long, label string, n_words string, score string"


def frame(spark, docs):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, x, 1, "l", "w", "s") for d, x in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Invented texts with copies, near copies, shared passages, odd characters and very long words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 160))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    docs = []
    for i in range(120):
        w = texts[i % 40].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage.split()
        docs.append((i * 7 % 120, ("\n" if i % 3 else "\t ").join([" ".join(w[:9]), " ".join(w[9:])]) + " " * (i % 2)))
    return docs + [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "one"), (205, "One two"), (206, "x" * 50_000), (207, texts[0]), (208, texts[0].upper()), (209, "a b " * 3000), (210, "a b " * 3000), (211, "don't 'tis we'll 　  42½ 中文\x1c\x85end '")]


def test_bpe_equals_library_and_decodes(spark, corpus):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_from(RANKS), special_tokens={})
    docs = dict(corpus)
    rows = byte_bpe.decode(byte_bpe.encode(frame(spark, corpus), RANKS), RANKS, offsets=True).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        text = docs[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
        pieces = [library.decode_single_token_bytes(x) for x in want]
        assert r.token_offsets == np.cumsum([0, *map(len, pieces)])[:-1].tolist()
    assert byte_bpe.encode(frame(spark, []), RANKS).count() == 0


def test_bpe_pieces_of_random_strings():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_from(RANKS), special_tokens={})
    rng = random.Random(2)
    alphabet = list("''  \n\t sretvlmdaé1٣!?.　 \x1c\x85中ßDS") + ["'s", "'re", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    import pyarrow as pa

    ids, first = byte_bpe.encode_texts(pa.array(texts), byte_bpe.rank_cache(RANKS))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(x) for x in texts]


def test_long_piece_merges_like_short_ones():
    ranks = byte_bpe.ranks_from(RANKS)
    rng = random.Random(3)
    for _ in range(200):
        piece = "".join(rng.choice("theandion") for _ in range(rng.randint(2, 40))).encode()
        assert byte_bpe.merge_long(piece, ranks) == byte_bpe.merge_piece(piece, ranks)


def test_token_files_round_trip_and_random_access(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    corpus = corpus + [(220, "a<|endoftext|>b"), (221, "<|endoftext|>"), (222, " <|endoftext|> <|endoftext|>\n<|endoftext"), (223, "中<|endoftext|>é")]
    manifest = token_codes.write_tokens(frame(spark, corpus + [(203, "one"), (None, "no id")]), path, file_tokens=3000)
    assert manifest.count() > 3
    rows = sorted(token_codes.read_tokens(spark, manifest, read_at_once=700).collect(), key=lambda r: r.start)
    order = [(None, "no id"), *sorted(corpus + [(203, "one")], key=lambda x: (x[0], x[1] or ""))]
    start = 0
    for r, (d, text) in zip(rows, order, strict=True):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (d, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert token_codes.read_tokens(spark, token_codes.write_tokens(frame(spark, []), path)).count() == 0


@pytest.mark.parametrize("top", [200, 60_000, 20_000_000])
def test_any_token_range_is_addressable(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 5000).astype(np.uint32)
    value = token_codes.file_bytes(np.arange(2), np.array([0, 1000, 5000]), ids)
    coded = token_codes.CodedFile(lambda at, length: value[at : at + length])
    for a, b in [(0, 5000), (0, 0), (511, 513), (4999, 5000), (1000, 1001), *np.sort(rng.integers(0, 5000, (40, 2))).tolist()]:
        assert coded.tokens(a, b).tolist() == ids[a:b].tolist()
    assert coded.offsets().tolist() == [0, 1000, 5000]


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (4, 85), (1, 60)])
def test_jaccard_groups_equal_brute_force(spark, corpus, width, percent):
    want, sizes = groups_by_jaccard(corpus, width, percent)
    rows = jaccard.similar_documents(frame(spark, corpus + [(203, "one"), (None, "one")]), width=width, percent=percent).collect()
    assert len(rows) == len(corpus) + 2
    for r in rows:
        assert (r.component_id, r.n_shingles) == ((None, 1) if r.doc_id is None else (want[r.doc_id], sizes[r.doc_id]))
    assert jaccard.similar_documents(frame(spark, [])).count() == 0


def test_jaccard_with_dear_and_open_documents(spark, monkeypatch):
    """A large group of near copies, and one line in most texts: every shingle is dear for some."""
    monkeypatch.setattr(jaccard, "DEAR", 2)
    monkeypatch.setattr(jaccard, "COMMON", 1000)
    rng = random.Random(8)
    line = [f"l{i}" for i in range(12)]
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base) if i % 2 else [f"u{i}x{j}" for j in range(rng.randint(2, 30))]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{i}"
        docs.append((i, " ".join(w + line * (i % 3 > 0))))
    want, _ = groups_by_jaccard(docs, 3, 80)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(frame(spark, docs), width=3).collect()} == want


def test_jaccard_when_one_pivot_is_chosen_in_both_star_rounds(spark):
    """Trees of near copies in which only parent and child are similar: some pairs have one pivot, but in different rounds."""
    rng = random.Random(1)
    ids = list(range(20_000))
    rng.shuffle(ids)
    docs, want = [], {}
    for g in range(100):
        fresh = (f"g{g}w{i}" for i in range(1, 1000))
        tree = [[next(fresh) for _ in range(100)]]
        for _ in range(rng.randint(4, 9)):
            w = list(rng.choice(tree))
            for i in rng.sample(range(100), 5):
                w[i] = next(fresh)
            tree.append(w)
        group = [(ids.pop(0), " ".join(w)) for w in tree]
        docs += group
        want |= groups_by_jaccard(group, 1, 90)[0]
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(frame(spark, docs), width=1, percent=90).collect()} == want


def test_jaccard_compares_few_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with up to nine words replaced or left out: few of those that are not linked to it are linked at all."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(500):
        w = list(base)
        for j in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(["", f"e{i}x{j}"])
        docs.append((i, " ".join(w)))
    compared = 0

    def counted(rows, label="table"):
        nonlocal compared
        kept = stored(rows, label)
        compared += kept.count() if label in ("pairs", "candidates") else 0
        return kept

    monkeypatch.setattr(jaccard, "stored", counted)
    want, _ = groups_by_jaccard(docs, 4, 85)
    rows = jaccard.similar_documents(frame(spark, docs), width=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert compared < 10 * len(docs)


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_links_within_a_star_equal_brute_force(spark, percent):
    """Members far and near, with tokens that one, two or many of them differ in, and two that share nothing in their differences."""
    rng = random.Random(percent)
    centre = set(range(80))
    sets = {0: centre}
    for i in range(1, 150):
        gone = set(rng.sample(range(80), rng.randint(0, 12)))
        more = {rng.choice([1000 + rng.randint(0, 9), 2000 + 50 * i + j]) for j in range(rng.randint(0, 12))}
        sets[i] = (centre - gone) | more
    members = spark.createDataFrame([(i, 0, len(x), len(x ^ centre), sorted(x ^ centre)) for i, x in sets.items()], "doc long, pivot long, n long, d int, apart array<long>")
    near = [(r.x, r.y) for r in jaccard.links_without_shared(members, percent).collect()]
    similar = {(x, y) for x, y in itertools.combinations(sets, 2) if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])}
    assert set(near) <= similar
    # one label for those linked so far, one each for the others
    joined = {d for pair in near for d in pair}
    label = {d: min(joined) if d in joined else d for d in sets}
    labels = spark.createDataFrame(list(label.items()), "doc long, label long")
    found = [(r.x, r.y) for r in jaccard.links_within_stars(members.join(labels, "doc"), percent).collect()]
    assert len(found) == len(set(found)) and set(found) == {(x, y) for x, y in similar if label[x] != label[y]}


def test_one_of_each_group_stays(spark, corpus):
    docs = corpus + [(203, "one"), (None, "one"), (204, None)]
    want, _ = groups_by_jaccard([x for x in corpus if x[0] != 204], 5, 80)
    kept = [r.doc_id for r in jaccard.one_of_each_group(frame(spark, docs)).select("doc_id").collect()]
    assert sorted(x for x in kept if x not in (None, 204)) == sorted(d for d, c in want.items() if c == d)
    assert kept.count(None) == 1 and kept.count(203) == 1


@pytest.mark.parametrize(("width", "shard"), [(50, 2000), (50, 20), (12, 7)])
def test_removed_passages_equal_brute_force(spark, corpus, width, shard):
    rows = substring.remove_repeats(frame(spark, corpus + [(None, corpus[0][1])]), width=width, gram=width * 2 // 5, shard=shard).collect()
    assert len(rows) == len(corpus) + 1
    want = removed_words(corpus, width)
    texts = dict(corpus)
    for r in rows:
        if r.doc_id is None:
            assert (r.n_removed, r.text) == (0, corpus[0][1])
            continue
        n, gone, w = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, len(gone)), r.doc_id
        assert words(r.text) == [x for i, x in enumerate(w) if i not in gone]
        if not gone:
            assert r.text == texts[r.doc_id]
        assert (r.n, r.label, r.score) == (1, "l", "s")
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_rows_of_one_id_do_not_count_against_each_other(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring.remove_repeats(frame(spark, [(1, text), (1, text), (1, "x " + text), (2, text + " y")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (1, 0), (2, 60)]


def test_automaton_finds_the_longest_matches():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        query = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        covered = {j for i in range(len(query) - 2) for t in texts if any(t[k : k + 3] == query[i : i + 3] for k in range(len(t) - 2)) for j in range(i, i + 3)}
        spans = substring.SuffixAutomaton(texts).spans(query, 3)
        assert {j for a, b in spans for j in range(a, b)} == covered


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(1500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(lo, hi))] for lo, hi in ((1, 9), (0, 15)))
        assert decontaminate.best_end(a, b)[0] == edits(a, b)


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_leaks_equal_brute_force(spark, block_words):
    rng = random.Random(9)
    vocabulary = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))) for i in range(12)] + [(20, None), (21, "?!"), (22, "w1é"), (3, "again W5É w6é w7é w8é w9é")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            piece = rng.choice(items[:12])[1].upper().split()
            for _ in range(rng.randint(0, 4)):
                piece[rng.randrange(len(piece))] = "edit"
            w[len(w) // 2 : len(w) // 2] = piece
        docs.append((i, ", ".join(w)))
    docs += [(90, None), (91, "")]
    want = {}
    for d, x in docs:
        for item, text in items:
            a = plain_words(text)
            if a and (e := edits(a, plain_words(x))) <= len(a) * 20 // 100:
                want[d, item] = min(e, want.get((d, item), 99))
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.contaminated(frame(spark, docs), benchmark, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(rows) == len(want)
    clean = decontaminate.without_leaks(frame(spark, docs), benchmark, block_words=block_words)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(frame(spark, []), benchmark).count() == 0
    assert decontaminate.without_leaks(frame(spark, docs), benchmark.limit(0)).count() == len(docs)


def test_statistics_and_fixed_rules(spark, corpus):
    extra = [(300, "a b c d e " * 2 + "f"), (301, "# a\n# a\n\n\n&|<>"), (302, "a b c d e f a b c d e"), (303, "x\n \nx\nx")]
    rows = quality.text_statistics(frame(spark, corpus + extra).select("doc_id", "text", "n")).withColumn("base_failed", quality.fixed_rules()).collect()
    texts = dict(corpus + extra)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == statistics(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_outliers_are_rejected_per_group_and_others_stay(spark):
    rng = random.Random(11)
    docs = []
    for i in range(900):
        lang = ("aa", "bb", None)[i % 3]
        w = ["x" * max(1, round(rng.gauss(4 if lang == "aa" else 8, 2))) + str(rng.randint(0, 10**6)) for _ in range(rng.randint(60, 200))]
        if i % 10 == 0:
            w = [x + "###" for x in w] if i % 20 else [x * 6 for x in w]
        docs.append((i, " ".join(w), lang, "s", "clash"))
    docs += [(1000, None, None, None, ""), (1001, "", "aa", None, "")]
    rows = {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_words string")).collect()}
    assert len(rows) == len(docs)
    assert not any(rows[i].kept for i in (*range(0, 900, 10), 1000, 1001))
    assert sum(rows[i].kept for i in range(900) if i % 10) >= 805
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def vector_rows(rng, n, outliers, at):
    """Four statistics of n rows around a point, some of them far away."""
    rows = rng.normal(size=(n, 4)) * [0.3, 0.2, 0.4, 0.3] + at
    rows[: int(outliers)] += rng.uniform(4, 6, size=(int(outliers), 4))
    return rows


def regular_log_det(rows):
    floors = np.diag([f**2 for f in quality.FLOORS.values()])
    return np.linalg.slogdet(np.cov(rows.T, bias=True) * quality.CONSISTENCY + floors)[1]


def test_estimates_are_the_least_determinant_of_all_subsets(spark):
    rng = np.random.default_rng(5)
    groups = {f"g{k}": vector_rows(rng, 9 + k, k % 3, k) for k in range(4)}
    df = spark.createDataFrame([(g, *map(float, r)) for g, rows in groups.items() for r in rows], "grp string, v1 double, v2 double, v3 double, v4 double").repartition(3)
    for e in quality.estimates(df).collect():
        rows = groups[e.grp]
        h = -(-3 * len(rows) // 4)
        best = min(itertools.combinations(range(len(rows)), h), key=lambda s: regular_log_det(rows[list(s)]))
        got = np.array([[e[f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        least = regular_log_det(rows[list(best)])
        assert e.n == len(rows) and least - 1e-9 <= np.linalg.slogdet(got)[1] <= least + 1  # a local minimum at worst
        if e.grp in ("g0", "g1", "g2"):  # steps from three starts find the very subset here
            assert np.allclose([e[f"m{i}"] for i in range(4)], rows[list(best)].mean(0))


def test_groups_are_drawn_to_their_language_by_their_rows(spark):
    rng = np.random.default_rng(8)
    sizes = {("a", "s"): 300, ("a", "t"): 20, ("a", "u"): 8, ("b", "s"): 2}
    rows = [(f"\x1f{x}", f"\x1f{x}\x1f{y}", *map(float, r)) for k, ((x, y), n) in enumerate(sizes.items()) for r in vector_rows(rng, n, 0, k)]
    df = spark.createDataFrame(rows, "k1 string, k2 string, v1 double, v2 double, v3 double, v4 double").withColumn("k0", F.lit("")).repartition(3)
    of = lambda k: {e.grp: e for e in quality.estimates(df.withColumn("grp", F.col(k))).collect()}
    own, lang, table = of("k2"), of("k1"), of("k0")[""]
    got = {e.grp: e for e in quality.models(df, 3).collect()}
    assert set(got) == set(own)
    weight = lambda n: max(0, n - 8) / (max(0, n - 8) + 50)
    for g, e in own.items():
        up = lang[g.rsplit("\x1f", 1)[0]]
        for i in range(4):
            w, v = weight(e.n), weight(up.n)
            want = w * e[f"m{i}"] + (1 - w) * (v * up[f"m{i}"] + (1 - v) * table[f"m{i}"])
            assert abs(got[g][f"m{i}"] - want) < 1e-6, (g, i)


def test_one_more_row_moves_no_distance_much(spark):
    rng = random.Random(4)
    texts = [" ".join("x" * rng.randint(2, 9) + str(rng.randint(0, 10**6)) for _ in range(rng.randint(50, 150))) for _ in range(600)]
    mean = {}
    for n in (99, 100):
        docs = [(i, x, "aa" if i < n else "bb", "s") for i, x in enumerate(texts) if i < n or i >= 200]
        out = quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).where(F.col("doc_id") < 99)
        mean[n] = out.agg(F.avg("distance2")).first()[0]
    assert abs(mean[99] - mean[100]) < 0.1 * mean[99]


def test_factored_distance_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4))
    c = a @ a.T + np.eye(4)
    x, m = rng.normal(size=4), rng.normal(size=4)
    row = {f"v{i + 1}": float(x[i]) for i in range(4)} | {f"m{i}": float(m[i]) for i in range(4)} | {f"c{i}{j}": float(c[i, j]) for j in range(4) for i in range(j + 1)}
    out = quality.factored(spark.createDataFrame([row])).withColumn("d", quality.distance()).first()
    assert abs(out.d - (x - m) @ np.linalg.inv(c) @ (x - m)) < 1e-9
    assert abs(out.log_det - np.linalg.slogdet(c)[1]) < 1e-9


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "Vilewort" + rng.choice(["", "s", "ly"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(700, None), (701, ""), (702, "A very VILEWORT-like text")]
    df, known = frame(spark, docs), spark.createDataFrame(labels + [(900, 1), (700, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_model(toxicity.training_rows(df, known))
    rows = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((rows[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert rows[700] == rows[701] < 0.5 <= rows[702] and all(0 <= x <= 1 for x in rows.values())
    assert {r.doc_id for r in df.where(toxicity.held_out("doc_id")).collect()} >= set(held)
    again = toxicity.train_model(toxicity.training_rows(df.repartition(7), known))
    assert np.allclose(again.weights, model.weights)
    none = toxicity.train_model(toxicity.training_rows(df, known.limit(0)))
    assert {r.score for r in toxicity.scored(df, none).collect()} == {0.0} or max(r.score for r in toxicity.scored(df, none).collect()) < 1e-9
    assert toxicity.scored(frame(spark, []), model).count() == 0


def test_ranks_file_is_read_whole():
    with open(RANKS, "rb") as f:
        assert byte_bpe.ranks_from(RANKS) == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
