"""Exact top-k, conversation repair and spelling variants against brute force on odd small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandmill.llm import dialogue, spelling, threshold

NAN, INF = float("nan"), float("inf")


def brute_top(rows, asked, k):
    def clean(pairs):
        return {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in pairs
                if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}

    out = collections.defaultdict(set)
    for q, v in clean(asked):
        out[q] |= {(-sum(a * b for a, b in zip(v, w)), i) for i, w in clean(rows) if i != q and len(w) == len(v)}
    return {q: sorted(found)[:k] for q, found in out.items() if found}


@pytest.mark.parametrize(("lists", "kind"), [(2, "gauss"), (3, "gauss"), (8, "ties"), (1, "ties"), (2, "hot")])
def test_exact_top_scores(spark, monkeypatch, lists, kind):
    monkeypatch.setattr(threshold, "SHARD_ROWS", 150)
    monkeypatch.setattr(threshold, "BLOCK_ROWS", 7)
    monkeypatch.setattr(threshold, "TILE", 3)
    r = np.random.default_rng(lists)
    v = r.normal(size=(400, 8)) / 8 if kind != "ties" else r.integers(-1, 2, (400, 8)) / 1024
    if kind == "hot":
        v[40:240] = v[40]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(3, v[3].tolist(), 1), (3, v[9].tolist(), 1)]
    rows += [(500, None, 1), (600, [NAN] + [0.0] * 7, 1), (700, [None] + [0.0] * 7, 1), (None, v[1].tolist(), 1), (800, [0.0] * 8, 1),
             (900, [1.0], 1), (901, [2.0], 1), (1000, [], 1), (1001, [], 1), (1100, [INF] * 8, 1)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    asked = base.where("vec_id % 20 = 0 or vec_id = 3")
    got = collections.defaultdict(list)
    for x in threshold.top_scores(base, asked, k=5, lists=lists).orderBy("query_id", "rank").collect():
        got[x.query_id].append((-x.score, x.vec_id))
        assert x.rank == len(got[x.query_id])
    assert got == brute_top([x[:2] for x in rows], [x[:2] for x in rows if x[0] is not None and (x[0] % 20 == 0 or x[0] == 3)], 5)


def test_exact_top_scores_without_rows(spark):
    base = spark.createDataFrame([(1, [1e300, -1e300]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert threshold.top_scores(base.limit(0), base.limit(0)).count() == 0 and threshold.top_scores(base, base.limit(0)).count() == 0
    most = math.floor(2**27 / math.sqrt(2))
    assert [r.score for r in threshold.top_scores(base, base.where("vec_id = 1")).collect()] == [1024 * most - 2048 * most]


def test_thresholds_leave_most_entries(spark):
    """The second phase collects a small part of all (query, vector, list) parts."""
    r = np.random.default_rng(1)
    parts = [r.normal(size=(50, 4000)) * 100 for _ in range(2)]
    whole = parts[0] + parts[1]
    kept = 0
    for q in range(50):
        cutoff = np.sort(whole[q])[-10]
        heads = [p[q].max() for p in parts]
        found = [p[q] * 2 >= 2 * h - sum(heads) + cutoff for p, h in zip(parts, heads, strict=True)]
        assert (found[0] | found[1])[whole[q] >= cutoff].all()
        kept += sum(f.sum() for f in found)
    assert kept < 0.05 * 2 * 50 * 4000


TEXTS = ["a.", "b", "", " \t", "c!", "d? ", None]


def brute_repair(rows):
    """(conv -> result) by trying each edit string in full: cheapest, then ASCII-least."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text, live in (r for r in rows if r[0] == conv):
            if live is not False:
                role, text = (" " if role is None else role), (" " if text is None else text)
                mine.append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), turn, role, text))
        mine.sort(key=lambda r: r[:3])
        seen, faults = set(), []
        for *_, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", [])}  # by the initials said so far, s and the last of u and a
        legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        name = {"u": "user", "a": "assistant"}

        def offer(found, state, entry):
            if state is not None and (state not in found or entry[:2] < found[state][:2]):
                found[state] = entry

        def insert(found):
            for _ in range(3):
                for state, (cost, audit, said) in list(found.items()):
                    for c in "ua":
                        offer(found, legal.get((state, c)), (cost + 5, audit + "I", said + [name[c] + ":"]))

        insert(best)
        for (*_, role, text), fault in zip(mine, faults, strict=True):
            found = {}
            for state, (cost, audit, said) in best.items():
                offer(found, state, (cost + 2, audit + "D", said))
                if fault not in ("b", "d"):
                    late = 5 * (fault == "t")
                    offer(found, legal.get((state, role[:1])), (cost + late, audit + "K", said + [f"{role}:{text}"]))
                    for c in "ua":
                        offer(found, legal.get((state, c)), (cost + 1 + late, audit + "R", said + [f"{name[c]}:{text}"]))
            insert(found)
            best = found
        cost, audit, said = min(best[s] for s in ("", "a") if s in best)
        turns = [r[3] for r in mine if r[3] is not None]
        illegal = sum(a[4][:1] + b[4][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
                     cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark):
    r = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(r.randrange(9)):
            rows.append((conv, r.choice([turn, turn, turn, None, 3]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]),
                         r.choice(TEXTS) if r.random() < 0.4 else f"{turn} says so.", r.random() > 0.1))
    rows += [(None, 1, "user", "x.", True), (None, 1, "user", "x.", None), (200, 0, "user", "y.", False), (201, 0, "user", "z" * 2_000_000 + ".", True), (201, 1, "assistant", "e.", True)]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, live boolean, kind int, key string")
    got = {x.conv_id: tuple(x)[1:] for x in dialogue.repair_conversations(df.repartition(5)).collect()}
    assert got == brute_repair(rows)
    assert dialogue.repair_conversations(df.limit(0)).count() == 0


def test_equal_edits_by_all_strings():
    """Every edit string up to a length, on short conversations: cheapest first, then ASCII-least."""
    r = random.Random(7)
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system"]), r.random() < 0.3, r.random() < 0.3) for _ in range(r.randrange(4))]
        want = None
        for n in range(len(rows) + 3):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(rows):
                    continue
                for extra in itertools.product("ua", repeat=sum(e in "IR" for e in audit)):
                    said, cost, left, named = "", 0, iter(rows), iter(extra)
                    for e in audit:
                        role, gone, late = next(left) if e != "I" else ("", False, False)
                        cost += {"D": 2, "I": 5, "K": 0, "R": 1}[e] + (5 if late and e != "D" else 0) + (1000 if gone and e != "D" else 0)
                        said += "" if e == "D" else role[0] if e == "K" else next(named)
                    if re.fullmatch("(s?(ua)+)?", said):
                        want = min(want or (cost, audit), (cost, audit))
        found = []
        repair = dialogue.Repair(lambda e, piece, found=found: found.append(e))
        for role, gone, late in rows:
            repair.row(role, "x", gone, late)
        assert (repair.close(), tuple(found)) == want


def test_survivors_coalesce():
    emitted = []
    repair = dialogue.Repair(lambda e, piece: emitted.append(e))
    for i in range(20_000):
        repair.row("user" if i % 2 == 0 else "assistant", str(i), False, i % 17 == 0)
    assert len(emitted) > 19_900 and repair.most < 200
    assert repair.close() > 0 and len(emitted) >= 20_000


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else None, None if t == 3 else "Hm. Yes? No!") for c in range(40) for t in (None, 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collections.Counter()
    for c, t, role, text in rows:
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if f == 4 else role or " ", "" if f == 1 else text or " "
        want[(c, t, role, re.sub("[.!?]", "", text) if f == 2 else text, f != 0)] += 1 + (f == 3)
    assert collections.Counter(tuple(x) for x in dialogue.damaged(df).collect()) == want


def brute_spelling(docs, least=2):
    n = collections.Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return brute_forms({w: c for w, c in n.items() if c >= least})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        n_near[w], form[w] = len(others), best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], words[form[w]] if form[w] else None)
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("letters", "product"), [(400_000, 1 << 22), (60, 40)])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, letters, product):
    monkeypatch.setattr(spelling, "PART_LETTERS", letters)
    monkeypatch.setattr(spelling, "PRODUCT", product)
    monkeypatch.setattr(spelling, "FLUSH", 50)
    r = random.Random(2)
    syllables = ["ba", "éo", "na", "ÿÉ", "ru", "st"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(3, 6))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(words[: 1 + r.randrange(60)]) for _ in range(200)).replace("b", "B", 20)) for i in range(40)]
    docs += [(None, "Wortıwort" + " abcdefgh中abcdefgh" * 3), (7, None), (8, ""), (9, "×" * 9 + "1" + "×" * 9), (5, docs[5][1]), (10, "lettreµs " * 5)]
    docs += [(11, "q" * 9000 + " " + "q" * 9000 + " " + "q" * 9001 + " " + "q" * 9001)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string")
    assert spelled(spelling.spelling_variants(df)) == brute_spelling(docs)


def test_roots_of_long_chains(spark):
    words = {"abcdefg" + "h" * k: 10**k for k in range(1, 12)} | {"zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    df = spark.createDataFrame([(w, n) for w, n in words.items()] + [(None, 3)], "word string, n long")
    got = spelled(spelling.spelling_forms(df))
    assert got == brute_forms(words) and got["abcdefgh"][1] == "abcdefg" + "h" * 11 and got["zzzzzzz"][0] == "zzzzzzx"
    assert spelling.spelling_forms(df.limit(0)).count() == 0


def test_no_documents(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
