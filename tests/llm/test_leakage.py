import random

from terroir.llm import leakage
from tests.conftest import rows

R = random.Random(8)
WORDS = ["w" + "".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
PASSAGES = {k: [R.choice(WORDS) for _ in range(n)] for k, n in enumerate((34, 41, 63, 20, 9, 5, 2, 1), 1)}


def half(p):
    return -(-len(p) // 2)


def dress(w, how):
    t = " ".join(w)
    return {
        "plain": t, "upper": t.upper(), "wrapped": "\n> ".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)), "markdown": " ".join(f"**{x}**" if k % 3 else x for k, x in enumerate(w)),
        "html": " ".join(f"<b>{x}</b>" if k % 3 else x for k, x in enumerate(w)), "json": t.replace(" ", "\\n"), "punct": ", ".join(w) + ".", "ansi": " ".join(f"\x1b[31m{x}\x1b[0m" for x in w), "accents": t.replace("a", "à").replace("e", "é"), "unicode": t.replace("a", "\\u00e0"), "entity": t.replace("e", "&eacute;"),
    }[how]


HOWS = ["plain", "upper", "wrapped", "markdown", "html", "json", "punct", "ansi", "accents", "unicode", "entity"]


def brute(docs, items):
    out = set()
    for d, t in docs:
        text = f" {' '.join(leakage.words(t))} "
        for i, p in items:
            w = leakage.words(p)
            if w and any(f" {' '.join(w[s : s + half(w)])} " in text for s in range(len(w) - half(w) + 1)):
                out.add((d, i))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


def test_runs_in_every_dress(spark):
    docs, want, k = [], [], 0
    noise = lambda n: " ".join(f"z{R.randrange(9999)}" for _ in range(n))
    for item, p in PASSAGES.items():
        if len(p) < 9:
            continue
        for how in HOWS:
            for n, leaks in ((len(p), True), (half(p), True), (half(p) - 1, False)):
                start = R.randrange(len(p) - n + 1)
                k += 1
                docs.append((k, f"{noise(30)} {dress(p[start : start + n], how)} {noise(30)}"))
                want += [(k, item)] if leaks else []
        shuffled = p[:]
        R.shuffle(shuffled)
        docs.append((10_000 + item, " ".join(shuffled)))
    items = [(i, " ".join(p)) for i, p in PASSAGES.items() if len(p) >= 9]
    got = rows(leakage.found(*frames(spark, docs, items)))
    assert [g for g in got if g[0] < 10_000] == sorted(want, key=str) and got == brute(docs, items)
    assert rows(leakage.found(*frames(spark, docs, items), item_bytes=0)) == got  # by join instead of travelling items


def test_short_passages_and_edges(spark):
    items = [(i, " ".join(p)) for i, p in PASSAGES.items()] + [(100, None), (101, ""), (102, "..."), (103, " ".join(PASSAGES[1])), (None, "x")]
    docs = [(1, None), (2, ""), (3, " ".join(PASSAGES[1])), (3, " ".join(PASSAGES[1])), (4, PASSAGES[8][0]), (5, "q " * 50_000 + " ".join(PASSAGES[2])), (6, " ".join(PASSAGES[6][:3]))]
    d, i = frames(spark, docs, items)
    want = brute([x for x in docs if x[1]], [x for x in items if x[0] is not None and x[1]])
    assert rows(leakage.found(d.selectExpr("*", "1 AS item_id", "'x' AS passage"), i)) == want and (3, 103) in want and (5, 2) in want
    assert leakage.found(d.limit(0), i).count() == 0 and leakage.found(d, i.limit(0)).count() == 0


def test_windows_keep_every_run():
    import numpy as np

    h = np.random.default_rng(1).integers(1, 2**60, 200, dtype=np.uint64)
    for length in (1, 3, 5, 17, 26):
        keys = leakage.window_keys(h, length)
        assert len(keys) == 200 - length + 1 and all(leakage.window_keys(h[k : k + length], length)[0] == keys[k] for k in range(0, len(keys), 37))
    assert leakage.partitions_of([17, 18, 22, 23, 40]) == {17: 17, 18: 17, 22: 17, 23: 23, 40: 40}


def test_a_tag_of_any_length_does_not_break_a_run():
    w = leakage.words
    image = f'<img src="data:image/png;base64,{"iVBORw0KGgo" * 1000}" alt="a plot">'
    assert w(f"one two {image} three") == ["one", "two", "three"]
    assert w(json_escaped := f"one two {image} three".replace('"', '\\"')) == ["one", "two", "three"] and len(json_escaped) > 10_000
    assert w("one <a href='" + "x" * 5000 + "'>two</a> th<b>re</b>e <td nowrap>four <!-- " + "no " * 500 + "-->five<br/>six</p>") == ["one", "two", "three", "four", "five", "six"]
    # a comparison in code is no tag, however far its other half is
    assert w("if a <b and c> d") == ["if", "a", "b", "and", "c", "d"] and w("i<n; " + "word " * 200 + "> 3").count("word") == 200


def test_a_very_long_passage(spark):
    n = 60_000
    passage = [f"v{(k * 7919) % n}" for k in range(n)]
    docs = [(1, " ".join(passage[10_000:40_000])), (2, " ".join(passage[10_000:39_999])), (3, "x " + " ".join(passage) + " y")]
    held = leakage.Items([(1, " ".join(passage))])
    stored = sum(a.nbytes for x in (held.known, held.owner, held.hashed) for a in x.values())
    assert stored < 30 * n  # linear in its words
    assert rows(leakage.found(*frames(spark, docs, [(9, " ".join(passage))]))) == [(1, 9), (3, 9)]


def test_runs_are_found_exactly():
    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(2))
        for n in (1, 2, 3, 5, 8, 13):
            want = any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))
            assert leakage.holds(a, b, n) == want
    h = np.random.default_rng(1).integers(1, 2**60, 90, dtype=np.uint64)
    for n in (1, 6, 7, 64, 90, 91):
        assert len(np.unique(leakage.run_keys(h, n))) == max(0, 90 - n + 1)


def test_bloom_filter(spark):
    import numpy as np

    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    bloom = leakage.bloom_of(spark.createDataFrame([(int(k),) for k in keys[:2500]], "k long"), bits=18)
    got = leakage.in_bloom(keys.view(np.uint64), bloom).view(np.int64)
    assert set(keys[:2500].tolist()) <= set(got.tolist()) and len(got) < 2600
    assert len(leakage.in_bloom(keys.view(np.uint64), leakage.bloom_of(spark.createDataFrame([], "k long"), bits=18))) == 0
