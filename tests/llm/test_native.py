"""Mixing, quality rules, decontamination and personal data against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_words import make_words as words
from pyspark.sql import functions as F

from gridloom.llm import decontamination, mixing, pii, quality_rules
from gridloom.llm.expressions import running_before

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_targets_and_caps(spark):
    rows = [(k, words(random.Random(k), 5 + k % 7), None, "abc"[k % 3] if k % 10 else "rare") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.plan_mix(docs).toPandas()
    per = plan.groupby("source").agg(size=("size", "sum"), first=("source_size", "first"), target=("target", "first"))
    assert (per["size"] == per["first"]).all()
    assert abs(per["target"].sum() - plan["size"].sum()) < 1e-6
    assert (per["target"] <= 3 * per["size"] + 1e-9).all()
    taken = (plan["size"] * plan["copies"]).groupby(plan["source"]).sum()
    assert ((taken / per["target"] - 1).abs() < 0.1).all()
    assert (plan["copies"] <= 3).all()
    again = mixing.plan_mix(docs.repartition(7)).toPandas()
    assert plan.set_index("id")["copies"].sort_index().equals(again.set_index("id")["copies"].sort_index())
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert mixed.count() == plan["copies"].sum()


def test_mix_without_broadcast_is_the_same(spark, odd, monkeypatch):
    key = lambda r: (r["id"] or -1, r["source"] or "", r["size"], r["copies"], r["target"])
    one = sorted(map(key, mixing.plan_mix(odd).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(key, mixing.plan_mix(odd).collect())) == one


def test_mix_odd(odd, odd_rows, empty):
    got = mixing.plan_mix(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r["size"] for r in got if r["id"] in (4, 5, 6)} == {0}
    assert mixing.plan_mix(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(odd).columns[: len(odd.columns)] == odd.columns


def brute_measures(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark, odd_rows):
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows] + ["a a a a a a", "a b c d e a b c d e", "x\nx\n\ny\nx", "é # | ö\n\té # | ö", "a b\x0bc\x0cd\re"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 2) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality_rules.judge(docs).collect():
        want = brute_measures(texts[r["id"]])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_odd(odd, odd_rows, empty):
    assert len(quality_rules.judge(odd).collect()) == len(odd_rows)
    assert quality_rules.judge(empty).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(decontamination.UPPER, decontamination.LOWER)


def brute_hits(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        b = WORD.findall((body or "").translate(LOWER))
        n = min(13, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(item)) if item is not None else None
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def bench_case():
    rng = random.Random(9)
    items = [(k, words(rng, rng.choice((3, 12, 13, 14, 40)))) for k in range(12)] + [(3, words(rng, 20)), (99, None), (98, " "), (None, words(rng, 15)), (100, "Ärger ÄRGER straße")]
    docs = []
    for k in range(40):
        body = words(rng, rng.randint(0, 200)).split(" ")
        if k % 2:
            part = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randint(0, len(body))
            body[cut:cut] = part[rng.randint(0, 2) :]
        text = " ".join(body)
        docs.append((k, text.upper() if k % 5 == 0 else text.replace(" ", " -- ")))
    docs += [(200, "ärger Ärger"), (201, "xx Ärger, ÄRGER; STRAßE yy"), (4, None), (5, ""), (7, docs[1][1]), (7, docs[1][1]), (None, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_against_brute_force(spark, bench_case, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    docs, items = bench_case
    found = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found)
    want = Counter()
    for i, t in docs:
        a, b, c, d = brute_hits(t, items)
        want[(i, a, b, tuple(c), d)] += 1
    assert got == want


def test_decontamination_of_capital_sigmas(spark):
    text = "ΟΔΟΣ'A ΦΩΣ:B ΝΟΜΟΣ.C " + " ".join(f"w{k}" for k in range(10))
    docs = spark.createDataFrame([(1, text), (2, text.lower())], "doc_id long, text string")
    found = decontamination.scan(docs, spark.createDataFrame([(5, text)], "item_id long, text string")).collect()
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found}
    for i, t in ((1, text), (2, text.lower())):
        assert got[i] == brute_hits(t, [(5, text)])[:3]
    assert got[1] == (16, 16, ["5"])


def test_decontamination_removal(spark, bench_case, odd, empty):
    docs, items = bench_case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.remove_documents(d, b).collect()
    assert Counter(map(tuple, kept)) == Counter((i, t) for i, t in docs if not brute_hits(t, items)[3])
    def unhit(text):
        """The words of a text outside all hits, folded."""
        w, hit = WORD.findall((text or "").translate(LOWER)), set()
        for _, body in items:
            g = WORD.findall((body or "").translate(LOWER))
            n = min(13, len(g))
            grams = {tuple(g[k : k + n]) for k in range(len(g) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
        return tuple(x for k, x in enumerate(w) if k not in hit)

    cleaned = Counter((i, tuple(WORD.findall((t or "").translate(LOWER)))) for i, t in decontamination.remove_spans(d, b).collect())
    assert cleaned == Counter((i, unhit(t)) for i, t in docs)
    clash = d.selectExpr("doc_id", "text", "1 as bad_id", "2 as bad_key", "3 as hit_id", "4 as hit_key", "5 as hit_spans", "6 as __bad_id", "7 as __spans")
    assert decontamination.remove_documents(clash, b).count() == len(kept)
    assert decontamination.remove_spans(clash, b).columns == clash.columns and decontamination.remove_spans(clash, b).count() == len(docs)
    assert decontamination.remove_documents(odd, b).columns == odd.columns
    assert decontamination.scan(empty, b).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_documents(odd, nothing).count() == odd.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def brute_pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_pii_base_against_brute_force(spark, odd_rows):
    rng = random.Random(2)
    parts = ["a@b.c", "a@b.cd_e@f.g", "..x@-.-", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.01.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-6789", "+12", "é😀", " ", ".", "9", "+", "-", "\n", "a_b@c.d@e.f.g", "1.2.3.1.2.3.4"]
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["1 " * 30_000, "1.2.3.4 " * 700, "a" * 100_000, "+1" * 5000, "4111111111111111, " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(docs).collect():
        for kind, want in brute_pii(texts[r["id"]]).items():
            assert [(s["start"], s["end"]) for s in r[kind]] == want, (kind, texts[r["id"]][:100])
            assert all(texts[r["id"]][s["start"] : s["end"]] == s["value"] for s in r[kind])


def test_pii_added_kinds_and_redaction(spark, empty, odd, odd_rows):
    texts = ["Konto DE89 3704 0044 0532 0130 00 THE", "GB82WEST12345698765432.", "DE89370400440532013001", "ssn 123-45-6789", "part 123-45-6789", "x a@b.cd y 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in pii.find(docs).collect()}
    assert [s["value"] for s in got[0]["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [s["value"] for s in got[1]["iban"]] == ["GB82WEST12345698765432"]
    assert got[2]["iban"] == []
    assert [s["value"] for s in got[3]["ssn"]] == ["123-45-6789"]
    assert got[4]["ssn"] == []
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[5] == "x [email] y [ip]"
    assert pii.find(empty).collect() == []
    assert pii.redact(odd).columns == odd.columns
    assert pii.redact(odd).count() == len(odd_rows)


def test_pii_secrets_and_scores(spark):
    key, near = "a1b2c3d4e5f6a7b8c9d0e1f2", "x" * 60
    texts = [
        f"token = {key}.", f"part {key}", f"{key} {near} token", f"key {'a' * 30} and {'1' * 30}", f"token {key[:19]}", f"secret {'a1' * 65}",
        f"token {'a' * 200_000}1 {key}", "mail a@b.cd " + near + " e@f.gh", "call +1 234 567 8901", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [d.kind for d in pii.DETECTORS]
    got = {r["id"]: r for r in pii.find(docs).select("*", pii.scored(*kinds).alias("scores")).collect()}
    assert [s["value"] for s in got[0]["secret"]] == [key] and got[0]["scores"] == "80"
    assert all(got[k]["secret"] == [] for k in (1, 2, 3, 4, 5, 9, 10))  # no word, too far, one kind of characters, too short, too long, nothing
    assert got[6]["secret"] == []  # a match between the word and the key
    assert got[7]["scores"] == "100,90" and got[8]["scores"] == "80" and got[9]["scores"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[0] == "token = [secret]."


def test_running_before(spark):
    got = spark.range(1).select(running_before(F.sequence(F.lit(1), F.lit(300)).cast("array<bigint>")).alias("x")).first()["x"]
    assert got == [k * (k + 1) // 2 for k in range(300)]


