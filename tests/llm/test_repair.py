"""Structure repair against an independent search over (state, cost, audit)."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest

from boxloom.llm import repair as rp
from tests.llm.helpers import prose, with_clashes

TO = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) of rows (initial, fault), fault being 0 sound, 1 truncated, 2 to delete: all states forward, with whole audits."""

    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                to = "a" if q == "u" else "u"
                best[to] = min(best.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
        return best

    best = inserted({"": (0, "")})
    for who, fault in rows:
        new = {}
        for q, (c, a) in best.items():
            ways = [(c + 4, a + "D", q)]
            if fault < 2:
                ways.append((c + 3 + 3 * fault, a + "R", "a" if q == "u" else "u"))
                if who in TO[q]:
                    ways.append((c + 3 * fault, a + "K", TO[q][who]))
            for cost, audit, to in ways:
                new[to] = min(new.get(to, (cost, audit)), (cost, audit))
        best = inserted(new)
    return min(best[q] for q in ("", "a") if q in best)


def told(rows):
    """The whole report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (*r[:3], r[3][:64], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append(2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1)
        seen.add((role, text))
    who = [r[2][:1] for r in rows]
    cost, audit = cheapest([(w, min(k, 2)) for w, k in zip(who, kinds, strict=True)])
    out, q, i = [], "", 0
    for letter in audit:
        said = "a" if q == "u" else "u"
        if letter == "D":
            i += 1
            continue
        name = {"a": "assistant", "u": "user"}[said]
        out.append(f"{name}:" if letter == "I" else f"{rows[i][2] if letter == 'K' else name}:{rows[i][3]}")
        q = who[i] if letter == "K" else said
        i += letter != "I"
    turns = [r[1] for r in rows if r[0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(who))
    return gaps, kinds.count(2), kinds.count(3), kinds.count(1), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_every_short_conversation():
    layers = rp.Layers()
    for n in range(4):
        for rows in itertools.product(range(16), repeat=n):
            assert layers.solve(bytes(rows)) == cheapest([("sua?"[r // 4], min(r % 4, 2)) for r in rows])


def test_long_conversations_and_cuts():
    r, layers = random.Random(5), rp.Layers()
    for _ in range(300):
        rows = bytes(r.choices(range(16), k=r.randint(4, 60)))
        cost, audit = layers.solve(rows)
        assert (cost, audit) == cheapest([("sua?"[x // 4], min(x % 4, 2)) for x in rows])
        cuts = sorted(r.sample(range(1, len(rows)), 3))
        sizes = [b - a for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        pieces, at, out = list(rp.cut_audit(audit, rows, sizes)), 0, []
        names = [str(i) for i in range(len(rows))]
        for (piece, q), n in zip(pieces, sizes, strict=True):
            out += rp.repaired(piece, q, rows[at : at + n], names[at : at + n], names[at : at + n])[0]
            at += n
        assert "".join(p for p, _ in pieces) == audit and out == rp.repaired(audit, rp.START, rows, names, names)[0]
    assert len(layers.steps) < 2000  # few words occur


def conversations():
    r = random.Random(9)
    texts = ["Yes.", "No!", "cut off", "  ", "", None, "Why?\n", "é 😀.", "x" * 70 + "1.", "x" * 70 + "2."]
    rows = [(c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), r.choice(texts)) for c in range(40) for t in range(r.randint(0, 9)) for _ in range(r.choice([1, 1, 2]))]
    rows += [(None, None, "user", "Hm."), (None, 2, "assistant", "Hm."), (77, None, "user", "a."), (77, None, "user", "a."), (78, 5, None, None), (79, 10, "user", prose(3, 5000))]
    return rows + [(1000, t // 2, ("user", "assistant")[t % 2], f"Turn {t % 150}" + ".,"[t % 7 == 0]) for t in range(400)] + [(1001, 0, "user", "same.")] * 300


@pytest.mark.parametrize("how", [{}, {"most_rows": 3}, {"most_chars": 40}])
def test_repair(spark, how):
    rows = conversations()
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:] for r in rp.digests(rp.repair(df, **how)).collect()}
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    assert got == {c: told(x) for c, x in by.items()}


def test_runs_keep_texts_apart(spark):
    df = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(50)], "conv_id long, turn long, role string, text string")
    out = rp.repair(df, most_rows=7).orderBy("part", "no").collect()
    assert len(out) > 7 and [x for r in out for x in r.texts] == [f"{t}." for t in range(50)] and {"".join(r.audit for r in out)} == {"K" * 50}


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(30) for t in range(5)] + [(None, 1, None, None), (1, None, "system", "x.")]
    got = Counter(map(tuple, rp.damaged(with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()))
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        want[c, t, "user" if k == 4 else role, text] += 0 if k == 0 else 2 if k == 3 else 1
    assert got == +want


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rp.digests(rp.repair(df)).count() == 0
