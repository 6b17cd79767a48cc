"""Language identification, near duplicates, classifiers, token counts and sharding: brute force, round trips, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_words import make_words as words

from gridloom.llm import labels as label_tools
from gridloom.llm import language_id, near_dedup, quality_classifier, sharding, token_counts, toxicity
from gridloom.llm.components import components
from gridloom.llm.wordhash import SPACED, chunks, hash_words

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_words(monkeypatch):
    from gridloom.llm import wordhash

    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 80)) for _ in range(50)] + ["", None, "x" * 500, "A a\tÄ ä", " lead", "trail "]
    for size in (2_000_000, 64, 7):
        monkeypatch.setattr(wordhash, "CHUNK", size)
        seen: dict[str, int] = {}
        for row, raw, offsets in chunks(pa.array(texts)):
            hashes, first, stems = hash_words(raw, offsets, SPACED, 2)
            for k in range(len(first) - 1):
                want = re.findall(r"[^\x20\x09-\x0D]+", texts[row + k] or "")
                got = hashes[first[k] : first[k + 1]].tolist()
                assert len(got) == len(want)
                for w, h in zip(want, got, strict=True):
                    low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                    assert seen.setdefault(low, h) == h
        assert len(set(seen.values())) == len(seen)


def shingle_sets(texts, size):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        k = min(size, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def brute_components(ids, texts, size=5, threshold=80):
    sets, parent = shingle_sets(texts, size), list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[find(k)].append(ids[k])
    least = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return [least[find(k)] if sets[k] else ids[k] for k in range(len(ids))], [len(s) for s in sets]


@pytest.fixture(scope="module")
def near_case():
    """Families of edits around the threshold, small sets, and copies."""
    rng = random.Random(4)
    texts = []
    for size in (4, 5, 6, 9, 30, 150, 400):
        for _ in range(6):
            base = words(rng, size).split(" ")
            for _ in range(8):
                edit = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    edit[rng.randrange(size)] = words(rng, 1)
                texts.append(" ".join(edit[rng.randint(0, 1) :]))
            texts.append(" ".join(base).upper())
    base = words(rng, 300).split(" ")  # one group whose members are near the base and not near each other
    for k in range(60):
        edit = list(base)
        for p in rng.sample(range(300), 4 + k // 8):
            edit[p] = words(rng, 1)
        texts.append(" ".join(edit))
    return texts + [None, "", " ", texts[0]]


def test_near_duplicates_against_brute_force(spark, near_case):
    ids = [7 * k + 1 for k in range(len(near_case))]
    docs = spark.createDataFrame(list(zip(ids, near_case, strict=True)), "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in near_dedup.group(docs).collect()}
    roots, sizes = brute_components(ids, near_case)
    assert [got[i]["component_id"] for i in ids] == roots
    assert [got[i]["n_shingles"] for i in ids] == sizes
    assert all(got[i]["kept"] == (i == r) for i, r in zip(ids, roots, strict=True))
    kept = near_dedup.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in zip(ids, roots, strict=True) if i == r)


def joins_what_links(sets, labels, links, threshold=80):
    """Whether the links are links, and join all labels that any link joins."""
    def classes(pairs):
        parent = {x: x for x in labels.values()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(labels[a])] = find(labels[b])
        return {x: find(x) for x in parent}

    jaccard = lambda a, b: 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    every = [(a, b) for b in sets for a in sets if a < b and jaccard(a, b)]
    one, two = classes(every), classes(links)
    same = lambda c: sorted(sorted(x for x in c if c[x] == r) for r in set(c.values()))
    return all(jaccard(a, b) for a, b in links) and same(one) == same(two), len(every)


@pytest.mark.parametrize("light", [64, 3, 0])
def test_the_exact_rest_misses_no_link(spark, monkeypatch, light):
    rng = random.Random(8)
    sets = {}
    for k in range(90):
        base = random.Random(k // 45).sample(range(1000 * (k // 45), 1000 * (k // 45) + 500), 40 + 10 * (k // 45))
        s = set(base)
        for _ in range(rng.randint(0, 6)):
            s.discard(rng.choice(base))
            s.add(rng.randint(5000, 5040))
        sets[k] = s
    for name, value in (("LIGHT", light), ("CELL", 2000), ("LEAST", 10), ("SIDE", 7), ("WIDE", 11)):
        monkeypatch.setattr(near_dedup, name, value)
    table = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, set array<long>").repartition(3)
    labels = {k: k - k % 2 for k in sets}
    left = spark.createDataFrame([(0, k, v) for k, v in labels.items()], "band long, node long, label long")
    links = [(r["a"], r["b"]) for r in near_dedup._rest_links(left, table, 80).collect()]
    good, every = joins_what_links(sets, labels, links)
    assert good and every > 50


def test_subsets_of_a_template_make_no_pairs(spark):
    """400 sets that are all at a similarity of about 0.75: none link, and no pairs are handed on."""
    rng = random.Random(12)
    sets = {k: set(rng.sample(range(1000), 860)) for k in range(400)}
    table = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, set array<long>").repartition(3)
    left = spark.createDataFrame([(0, k, k) for k in sets], "band long, node long, label long")
    assert near_dedup._rest_links(left, table, 80).count() == 0
    met = near_dedup._prefixes(table, left.select("node", "label"), 80)
    rare = met.groupBy("token").count().filter(f"count <= {near_dedup.LIGHT}").select("token")
    assert near_dedup._light_pairs(met.join(rare, "token"), 80).count() < 400 * 399 / 2 / 20


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = 2000
            both = rng.integers(0, 2**64, int(2 * n * share / (1 + share)), dtype=np.uint64)
            regs = []
            for _ in range(2):
                s = np.unique(np.r_[both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)])
                bucket = (s >> np.uint64(57)).astype(int)
                at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                low = np.zeros(128, np.uint64)
                low[bucket[at]] = (s[at] & np.uint64((1 << 57) - 1)) + np.uint64(1)
                regs.append(near_dedup.registers(low[None, :]))
            errors.append(near_dedup.jaccard(*regs)[0][0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_near_duplicates_odd(odd, odd_rows, empty):
    got = near_dedup.group(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert all(by[i]["kept"] and by[i]["n_shingles"] == 0 for i in (4, 5, 6))
    assert {r["component_id"] for r in got if r["id"] is None} == {1, None}
    kept = [r["text"] for r in near_dedup.deduplicate(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, {r[1] for r in odd_rows} - {odd_rows[2][1]}))
    assert near_dedup.group(empty).collect() == []
    assert near_dedup.deduplicate(odd).columns == odd.columns


def test_near_duplicates_with_null_and_clashing_ids(spark):
    rng = random.Random(13)
    base = words(rng, 200).split(" ")
    edit = lambda *at: " ".join("zz" if k in at else w for k, w in enumerate(base))
    chain = [edit(), edit(50, 51, 52), edit(50, 51, 52, 100, 101, 102, 103, 104, 105, 106, 107, 108)]
    other, alone = words(rng, 50), words(rng, 60)
    rows = [("1", chain[0]), (None, chain[1]), ("3", chain[2]), ("5", chain[0]), ("5", other), (None, alone), (None, alone), ("7", "few"), ("7", "few")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id string, text string, its_id int, key int, label int")
    got = sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.group(docs).collect())
    assert sorted((i, c) for i, _, c in got) == sorted([("1", "1"), ("None", "1"), ("3", "1"), ("5", "1"), ("5", "5"), ("None", "None"), ("None", "None"), ("7", "7"), ("7", "7")])
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", chain[0]), ("5", other), ("None", alone), ("7", "few")])


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 9), (9, 8)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100}
    assert got[7] == got[8] == got[9] == 7


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 5 <> 0"))
    got = {r["id"]: r for r in language_id.identify(docs, model).collect()}
    rows = [r for r in docs.collect() if r["doc_id"] % 5 == 0]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.97


def brute_path(model, w):
    """Plain Viterbi for the words of one text."""
    fit = [sum(model.scores[t] for t in w.trigram[f : f + n]) for f, n in zip(w.first, w.sizes, strict=True)]
    for k, s in enumerate(w.script):
        allowed = model.candidates[s] if model.candidates[s].any() else np.ones(len(model.languages), bool)
        fit[k] = np.where(allowed, fit[k], -1e9).astype(float)
    best, back = fit[0], []
    for f in fit[1:]:
        ways = best[:, None] - language_id.PENALTY * (1 - np.eye(len(best)))
        back.append(ways.argmax(0))
        best = ways.max(0) + f
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


def test_language_spans_and_path(spark):
    rng = random.Random(5)
    rows = [(words(rng, 80, "aeiou"), "v"), (words(rng, 80, "bcdfg"), "c"), (words(rng, 80, "абвгд"), "ru"), (words(rng, 80, "aeiobc"), "v")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    text = f"{words(rng, 12, 'aeiou')} {words(rng, 12, 'bcdfg')}. {words(rng, 5, 'абвгд')} 123"
    r = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in r["spans"]] == ["v", "c", "ru"]
    assert text[r["spans"][2]["start"] : r["spans"][2]["end"]].strip() == text.split(". ")[1][:-4]
    texts = [words(rng, rng.randint(1, 30), "abcdeaeiouг") for _ in range(20)]
    w = language_id.words_of(texts)
    path = language_id.label_words(model, w)
    for d, t in enumerate(texts):
        want, total = brute_path(model, language_id.words_of([t]))
        own = path[w.doc == d].tolist()
        fit = language_id.words_of([t])
        value = 0.0
        for k, lang in enumerate(own):
            allowed = model.candidates[fit.script[k]]
            value += float(sum(model.scores[x][lang] for x in fit.trigram[fit.first[k] : fit.first[k] + fit.sizes[k]])) if allowed[lang] or not allowed.any() else -1e9
            value -= language_id.PENALTY if k and own[k - 1] != lang else 0
        assert own == want or value == pytest.approx(total, abs=1e-3)


def test_language_of_marks_and_long_texts(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(words(rng, 80, "aeiou"), "v"), (words(rng, 80, "bcdfg"), "c")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["\u0301\u0302 \u0301", "a\u0301 \u0302", "x" * 90 + " " + words(rng, 60, "aeiou") + " " + words(rng, 50, "bcdfgé"), "", words(rng, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: [tuple(r) for r in language_id.identify(docs, model).sort("id").collect()]
    whole = found()
    assert whole[0][1:3] == ("und", 0.0) and whole[1][1] in "vc" and whole[1][2] == 1.0
    one = language_id.words_of(texts)
    for size in (7, 40):
        monkeypatch.setattr(language_id, "CHUNK", size)
        monkeypatch.setattr(language_id, "BLOCK", 5)
        cut = language_id.words_of(texts)
        assert all(np.array_equal(getattr(one, c), getattr(cut, c)) for c in one.__dataclass_fields__)
        assert np.array_equal(language_id.label_words(model, one), language_id.label_words(model, cut))


def test_language_of_long_texts_in_blocks(monkeypatch):
    """The blocks' path is the walk's own, ties and scripts without a label included."""
    rng = np.random.default_rng(7)
    model = language_id.Model(["a", "b", "c"], np.round(rng.normal(-9, 2, (language_id.BUCKETS, 3)), 1).astype(np.float32), np.arange(3 * (language_id.OTHER + 1)).reshape(-1, 3) % 4 > 0)
    draw = random.Random(8)
    texts = [words(draw, n, "abcdeäгд") for n in (1, 2, 7, 60, 401, 900, 3)] + ["e " * 500, ""]
    w = language_id.words_of(texts)
    want = language_id.label_words(model, w)
    for long in (0, 1, 5, 59, 400):
        monkeypatch.setattr(language_id, "LONG", long)
        assert np.array_equal(language_id.label_words(model, w), want)


def test_long_texts_cost_what_short_ones_do(spark):
    """One text of 300,000 words, and one of letters only, through the operators that once walked over them."""
    import time

    rng = random.Random(2)
    text = words(rng, 300_000, "aeioubc")
    model = language_id.train(spark.createDataFrame([(words(rng, 80, "aeiou"), "v"), (words(rng, 80, "bcdfg"), "c")], "text string, lang string"))
    w = language_id.words_of([text])
    began = time.perf_counter()
    language_id.label_words(model, w)
    assert time.perf_counter() - began < 5  # a walk by words takes over ten
    docs = spark.createDataFrame([(1, text), (2, "x" * 5_000_000), (3, "x" * 4_999_999 + "y"), (4, "")], "doc_id long, text string")
    got = {r["id"]: r for r in language_id.identify(docs, model, spans=False).collect()}
    assert got[2]["n_spans"] == 1 and got[1]["n_spans"] > 100
    groups = {r["id"]: r for r in near_dedup.group(docs).collect()}
    assert groups[2]["n_shingles"] == 1 and groups[2]["component_id"] == 2 and groups[3]["component_id"] == 3


def test_language_odd(odd, odd_rows, empty):
    model = language_id.train(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(odd_rows)
    assert {(r["lang_pred"], r["score"]) for r in got if r["id"] in (4, 5, 6, 10)} == {("und", 0.0)}
    assert language_id.identify(empty, model).collect() == []
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.select(odd, model).columns == odd.columns


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_against_the_library(spark, pieces, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rng = random.Random(6)
    letters = list("aaabbcdeeethionsrABC  \n\n\t.,123é€Ω漢▁▁<s>\x00İß😀　\xa0-_=(){};'\"")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()] + ["", " ", "\n", "▁", "a" * 3000, "<s></s>"]
    solid = "abcdehtions漢字かなé=+/0123"
    texts += ["".join(rng.choice(solid) for _ in range(rng.randint(50, 900))) for _ in range(60)] + [None]
    want = [len(x) for x in library.encode([x or "" for x in texts])]
    for chunk, meet, block, states in ((1 << 12, 64, 1 << 22, 400_000), (16, 4, 64, 400_000), (7, 3, 1000, 500), (3, 1, 7, 50)):
        for name, value in (("CHUNK", chunk), ("MEET", meet), ("BLOCK", block), ("STATES", states)):
            monkeypatch.setattr(token_counts, name, value)
        t = token_counts.Transducer(token_counts.read_model(pieces))
        assert token_counts.count_texts(t, pa.array(texts)).tolist() == want
        assert token_counts.count_texts(t, pa.array(texts).slice(7, 40)).tolist() == want[7:47]


def test_state_maps_are_associative(pieces):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdehtions漢é=+/01") for _ in range(900))
    t = token_counts.Transducer(token_counts.read_model(pieces))
    whole = t.read(t.start, 0, text)
    for _ in range(20):
        i, j = sorted(rng.sample(range(1, 900), 2))
        a, b, c = (token_counts.StateMap.of(t, text, lo, hi) for lo, hi in ((0, i), (i, j), (j, 900)))
        for made in (a.then(t, b).then(t, c), a.then(t, b.then(t, c))):
            assert (made.tokens, made.out[None]) == (whole[1], whole[0][None])


def test_token_counts_of_a_long_text_without_spaces(pieces):
    """Memory grows with the text and no faster."""
    import tracemalloc

    rng = random.Random(10)
    peaks = []
    for size in (1 << 18, 1 << 20):
        text = "".join(rng.choices("的一是不了在人有我他这中大来上", k=size))
        t = token_counts.Transducer(token_counts.read_model(pieces))
        tracemalloc.start()
        token_counts.count_texts(t, pa.array([text]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 4.5 * peaks[0] and peaks[1] < 120e6


def test_token_counts_odd(odd, odd_rows, empty, pieces):
    got = token_counts.count_tokens(odd, pieces).collect()
    assert len(got) == len(odd_rows)
    assert {(r["n_bytes"], r["n_tokens"]) for r in got if r["id"] in (4, 5)} == {(0, 0)}
    assert [r["over_limit"] for r in got if r["id"] == 9] == [True]
    assert token_counts.count_tokens(empty, pieces).collect() == []


def test_quality_held_out(spark, odd, odd_rows, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.train(docs, labels.filter("doc_id % 4 <> 2"))
    score = {r["id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    held = [(score[r["doc_id"]], r["quality"]) for r in labels.filter("doc_id % 4 = 2").collect()]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    got = quality_classifier.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["id"] in (4, 5)}) == 1
    assert quality_classifier.score(empty, model).collect() == []
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(odd, none).collect()} == {0.5}


def test_quality_sample_holds_a_rare_class(spark, monkeypatch):
    assert label_tools.rates({0: 1000, 1: 10}, 100) == {0: 0.09, 1: 1.0}
    assert label_tools.rates({0: 400, 1: 100}, 100) == {0: 0.125, 1: 0.5}
    assert label_tools.rates({1: 50}, 100) == {1: 1.0}
    monkeypatch.setattr(quality_classifier, "SAMPLE", 120)
    rng = random.Random(4)
    rows = [(k, "## $$ %% " * 30 if k % 100 == 0 else words(rng, 90)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 100 == 0)) for k in range(1500)], "doc_id long, quality int")
    score = {r["id"]: r["score"] for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()}
    assert min(score[k] for k in range(0, 1500, 100)) > 0.7 > 0.3 > max(score[k] for k in range(1500) if k % 100)



def test_attention_gradient():
    rng = np.random.default_rng(0)
    shapes = {"W": (quality_classifier.WIDTH, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "a": (2,), "c": (3,), "d": (1,)}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}
    x, begin, y = rng.normal(size=(6, quality_classifier.WIDTH)) * 0.1, np.array([0, 1, 4, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality_classifier._forward(w, x, begin)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in quality_classifier._gradient(w, x, begin, y).items():
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-6
        up = loss()
        w[k][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-5)
        w[k][at] += 1e-6


def test_quality_is_fitted_on_all_passages():
    texts = [words(random.Random(8), n) for n in (1, 64, 65, 40 * 64)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0, 1], pa.int32()), pa.array(texts)], names=["label", "text"])
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, quality_classifier.WIDTH) for got in quality_classifier._bags([batch]) for b in got.column("bag")]
    assert [len(b) for b in bags] == [1, 1, 2, 40, 1]


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    rows = []
    for k in range(1200):
        text = words(rng, rng.randint(20, 80), "abcdefghijkl").split(" ")
        toxic = k % 7 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["zzfoul", "zzvile"]) + rng.choice(["", "er", "en", "ung", "s"]))
        rows.append((k, " ".join(text), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.filter("doc_id % 4 <> 1").select("doc_id", "toxic"))
    again = toxicity.unpack(toxicity.pack(model))
    assert (again.known == model.known).all() and (again.values == model.values).all()
    got = {r["id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = [(got[k], t) for k, _, t in rows if k % 4 == 1]
    assert np.mean([p for p, t in held if not t]) < 0.01
    assert np.mean([p for p, t in held if t]) > 0.9


def test_toxic_stretches_are_found_at_any_word():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 9, 30):
        ratio = rng.normal(size=n)
        want, free = [], np.ones(n, bool)
        sums = [ratio[k : k + 3].sum() for k in range(max(n - 2, 1))]
        for k in np.argsort(sums)[::-1]:
            if free[k : k + 3].all() and len(want) < toxicity.TOP:
                want.append(sums[k] / 3)
                free[k : k + 3] = False
        got = toxicity._stretches(np.r_[np.full(5, 9.0), ratio, np.full(4, 9.0)], np.array([0, 5, 5, 5 + n, 9 + n]))
        assert np.allclose(got[2], [max(want), sum(want) / toxicity.TOP]) and (got[1] == 0).all()
    foul = np.array([0, 0, 5, 5, 0, 0, 0.0])
    for ahead in range(3):  # neutral words in front change nothing
        assert toxicity._stretches(np.r_[np.zeros(ahead), foul], np.array([0, 7 + ahead]))[0].tolist() == [10 / 3, 10 / 9]


def brute_kneser_ney(texts):
    """Log-likelihood ratio of a word under plain Kneser-Ney models of [(words, class)]."""
    order, begin, end = toxicity.ORDER, b"\x01", b"\x02"
    runs_of = lambda w: [(begin * (order - 1) + w + end)[k : k + order] for k in range(len(w) + 1)]
    top = [defaultdict(int), defaultdict(int)]
    for ws, c in texts:
        for w in set(ws):
            for g in runs_of(w):
                top[c][g] += 1
    levels, above = {}, {g: top[0].get(g, 0) + top[1].get(g, 0) for g in set(top[0]) | set(top[1])}
    for size in range(order - 1, 0, -1):
        tails = defaultdict(int)
        for g, n in above.items():
            tails[g[1:]] += n if g[1:2] == begin else 1
        levels[size] = above = dict(tails)

    def model(table):
        d = toxicity._discounts(*(sum(n == k for n in table.values()) for k in (1, 2, 3, 4)))
        totals = defaultdict(lambda: [0, 0.0])
        for g, n in table.items():
            totals[g[:-1]][0] += n
            totals[g[:-1]][1] += d[min(n, 3) - 1]
        return table, d, dict(totals)

    def p(m, g, lower, more=0.0):
        table, d, totals = m
        if g[:-1] not in totals:
            return lower
        total, freed = totals[g[:-1]]
        n = table.get(g, 0)
        return ((n - d[min(n, 3) - 1] if n else 0.0) + (freed + more) * lower) / (total + more)

    levels[order] = {g: top[0].get(g, 0) + top[1].get(g, 0) for g in set(top[0]) | set(top[1])}
    shared, own = {k: model(v) for k, v in levels.items()}, [model(dict(t)) for t in top]

    def ratio(w):
        out = 0.0
        for g in runs_of(w):
            q = 1 / 256
            for size in range(1, order + 1):
                q = p(shared[size], g[-size:], q)
            out += np.log(p(own[1], g, q, toxicity.SHARED) / p(own[0], g, q, toxicity.SHARED))
        return out

    return ratio


def test_toxicity_against_plain_kneser_ney(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["漢字", "zz" * 30]
    rows = [(k, " ".join(rng.choices(vocabulary, k=12) + ["qqfoul"] * (k % 5 == 0) + ["QQ-fine!"] * (k % 7 == 0)), int(k % 5 == 0)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    cut = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())]
    ratio = brute_kneser_ney([(cut(t), c) for _, t, c in rows])
    asked = [(1, "qqfoul"), (2, "fine"), (3, None), (3, ""), (None, "qqfoul abc unseen"), (4, "x" * 300), *((10 + k, t) for k, t, _ in rows)]
    table = spark.createDataFrame(asked, "doc_id long, text string")
    got = sorted((tuple(r) for r in toxicity.score(table, model).collect()), key=str)
    for r in got:
        text = dict(asked)[r[0]] or ""
        want = [ratio(w) for w in cut(text)]
        assert r[2] == pytest.approx(np.mean(want) if want else 0, abs=1e-4)
        mixed = sum(np.log(1 - toxicity.MIXED + toxicity.MIXED * np.exp(x)) for x in want)
        assert r[5] == pytest.approx(mixed / np.sqrt(max(len(want), 1)), abs=1e-4)
    by = {r[0]: r[2] for r in got}
    assert by[1] > 1 and by[2] < by[1] and by[4] == pytest.approx(ratio(b"x" * 300), abs=1e-4)
    for name, value in (("BROADCAST", 0), ("BLOCK", 3000), ("SLICE", 300), ("HELD", 2000)):
        monkeypatch.setattr(toxicity, name, value)
    many = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert many.known is None and many.entries == len(model.known)
    again = sorted((tuple(r) for r in toxicity.score(table, many).collect()), key=str)
    assert [r[0] for r in again] == [r[0] for r in got]
    assert np.allclose([r[1:] for r in again], [r[1:] for r in got], atol=1e-6)


def test_toxicity_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(16)
    texts = [words(rng, 400), "", "z" * 900, words(rng, 30), words(rng, 300, "aé漢")]
    parts = np.array([0, 1, 2, 3, 1])
    runs, counts, _ = toxicity._tally(next(iter(toxicity._pieces(pa.array(texts))))[3], parts, np.zeros(0, np.uint64))
    m = toxicity.Model(*(lambda k: (np.sort(k), np.linspace(-2, 2, len(k)).astype(np.float32)))(toxicity._keys(runs)[0][::2]), np.array([1, 0.5, 0.2, 0.3, 0.1]), 0)
    whole = pa.Table.from_batches(toxicity._rated(m, pa.array(range(5)), pa.array(texts)))
    from gridloom.llm import wordhash

    monkeypatch.setattr(wordhash, "CHUNK", 300)
    monkeypatch.setattr(toxicity, "CHUNK", 950)
    assert len(list(toxicity._pieces(pa.array(texts)))) > 5
    cut = pa.Table.from_batches(toxicity._rated(m, pa.array(range(5)), pa.array(texts)))
    assert cut.column("id").to_pylist() == list(range(5))
    assert np.allclose(np.array(cut.drop("id").to_pandas()), np.array(whole.drop("id").to_pandas()))
    batch = pa.RecordBatch.from_arrays([pa.array(parts), pa.array(texts)], names=["part", "text"])
    got = pa.Table.from_batches(toxicity._counts([batch])).to_pydict()
    assert got["run"] == runs.tolist() and np.array_equal(np.column_stack([got[f"n{k}"] for k in range(4)]), counts)


def test_toxicity_of_a_rare_class(spark, monkeypatch):
    """More labels than the calibration takes, few of them toxic; and a toxic expression spread over a text counts."""
    monkeypatch.setattr(toxicity, "CALIBRATION", 300)
    rng = random.Random(12)
    rows = []
    for k in range(3000):
        text = words(rng, rng.randint(30, 90), "abcdefghijkl").split(" ")
        for _ in range(4 if k % 50 == 0 else int(k % 17 == 0)):
            text.insert(rng.randint(0, len(text)), "zzfoul" + rng.choice("abcdef"))
        rows.append((k, " ".join(text), int(k % 50 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.filter("doc_id % 4 <> 2").select("doc_id", "toxic"))
    got = {r["id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = [(got[k], t) for k, _, t in rows if k % 4 == 2]
    assert np.mean([p for p, t in held if t]) > 0.8 and np.mean([p for p, t in held if not t]) < 0.02


def test_discounts_stay_in_their_bounds():
    assert toxicity._discounts(600, 200, 100, 60) == pytest.approx((0.6, 1.1, 1.56))
    for few in ((0, 0, 0, 0), (5, 0, 0, 0), (5, 1, 0, 0), (1, 9, 99, 999), (9, 9, 0, 9)):
        d = toxicity._discounts(*few)
        assert 0 < d[0] < 1 and 0 < d[1] < 2 and 0 < d[2] < 3


def test_toxicity_odd(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 0), (9, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.train(odd, labels.limit(0))
    assert max(r["score"] for r in toxicity.score(odd, none).collect()) < 0.01


def check_shards(rows, total):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert sum(r["size"] for r in rows) == total
    return {s: sum(r["size"] for r in v) for s, v in by.items()}


def test_sharding_balance_and_groups(spark):
    rng = random.Random(11)
    rows = [(k, words(rng, rng.randint(1, 60))) for k in range(4000)]
    rows += [(5000 + k, "the same text again and again " * 20) for k in range(900)]  # a third of all bytes
    rows += [(6000 + 100 * g + k, f"group {g} of some size " * 30) for g in range(4) for k in range(12 + 7 * g)]  # up to a tenth of a shard
    rows += [(7000 + 3 * k + j, f"pair {k} " * 5) for k in range(150) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(docs).collect()
    sizes = check_shards(got, sum(len(t.encode()) + 1 for _, t in rows))
    due = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s / due - 1) < 0.03 for s in sizes.values())
    split = defaultdict(set)
    text = dict(rows)
    for r in got:
        split[text[r["id"]]].add(r["shard"])
    assert [t[:8] for t, v in split.items() if len(v) > 1] == ["the same"]  # it is larger than a shard
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(3)).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in got}


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    docs = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(3000)], "doc_id long, text string")
    keyed = docs.selectExpr("cast(length(text) + 1 as long) as size", "xxhash64(text) as key_hash", "doc_id as key_id", "0L as key_tie")
    total = keyed.agg({"size": "sum"}).first()[0]
    _, sums = sharding._ranged(keyed, total, 8)
    due = total / (8 * sharding.RANGES_PER_SHARD)
    assert max(r["bytes"] for r in sums) <= sharding.OVERFULL * due + 50


def test_sharding_odd(odd, odd_rows, empty):
    got = sharding.shard(odd).collect()
    assert len(got) == len(odd_rows)
    check_shards(got, sum(len((r[1] or "").encode()) + 1 for r in odd_rows))
    assert {r["size"] for r in got if r["id"] in (4, 5)} == {1}
    assert sharding.shard(empty).collect() == []
    named = odd.selectExpr("concat('doc-', doc_id) as doc_id", "text")
    check_shards(sharding.shard(named).collect(), sum(len((r[1] or "").encode()) + 1 for r in odd_rows))


