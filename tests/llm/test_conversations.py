"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sitewright.llm import conversations, queries

WHITE = " \t\n\x0b\x0c\r"


def least_audit(roles, forced, late):
    """(cost, audit) by a forward search that keeps the least (cost, letters) of each state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                t = new[q]
                best[t] = min(best.get(t, (c + 9, "")), (c + 3, a + "I")) if t in best else (c + 3, a + "I")
        return best

    best = {"": (0, "")}
    for role, must, cut in zip(roles, forced, late):
        after = {}
        for q, (c, a) in inserted(best).items():
            options = [(q, c + 4, a + "D")]
            if not must:
                options.append((new[q], c + 3 + 3 * cut, a + "R"))
                if role[:1] in step[q]:
                    options.append((step[q][role[:1]], c + 3 * cut, a + "K"))
            for t, cost, audit in options:
                after[t] = min(after.get(t, (cost, audit)), (cost, audit))
        best = after
    return min(best_end for q, best_end in inserted(best).items() if q in ("", "a"))


def expected(rows, ids):
    """The query's columns, one conversation after the other."""
    out = {}
    for conv in ids:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            name = lambda x: " " if x is None else str(x)
            code = zlib.crc32(f"{name(c)}:{name(turn)}".encode()) % 20
            if code:
                role = "user" if code == 4 else role
                text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
                own += [(turn, role, text)] * (2 if code == 3 else 1)
        hashes = {t: h for t, h in zip({x[2] for x in own}, range(len(own)))}
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
        seen, forced, late, counts = set(), [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            last = text.rstrip(WHITE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            forced.append(fault in ("blank", "duplicate"))
            late.append(fault == "truncated")
            if fault:
                counts[fault] += 1
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = least_audit([r for _, r, _ in own], forced, late)
        state, said, left = "", [], iter(own)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            new = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[new]
            state = role[0]
            said.append(f"{role}:{row[2] if row else ''}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs),
                     cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def answer(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def write(spark, rows, folder):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as conv", "'own' as pos", "'own' as block").write.parquet(f"{folder}/conversations.parquet")


def random_rows(seed, conversations_, turns):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \n", "d? ", "é…", "x. y", None]
    # no two rows of one turn, so that the order is the contract's
    return [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts))
            for c in range(conversations_) for t in rng.sample(range(turns + 3), rng.randint(0, turns))]


@pytest.mark.parametrize("bits", [8, 1])
def test_same_as_plain_search(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = random_rows(bits, 150, 12) + [(None, t, r, x) for t, r, x in ((None, "user", "q."), (1, "assistant", "a."), (4, "tool", "z"))]
    rows += [(7000, t, "user" if t % 3 else "assistant", f"t{t % 50}.") for t in range(900)]  # one conversation of many blocks
    write(spark, rows, tmp_path)
    ids = {r[0] for r in rows}
    assert answer(queries.op11_path_ranking(spark, str(tmp_path))) == expected(rows, ids)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "user", "same.")] * 700 + [(1, 1, "assistant", "fine.")] + [(2, None, None, None)] * 3
    write(spark, rows, tmp_path / "a")
    assert answer(queries.op11_path_ranking(spark, str(tmp_path / "a"))) == expected(rows, {1, 2})
    write(spark, [], tmp_path / "b")
    assert answer(queries.op11_path_ranking(spark, str(tmp_path / "b"))) == {}


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(queries.op11_path_ranking(spark, "/root/testdata/sf0.01")) == expected(rows, {r[0] for r in rows})


def test_ranks_choose_the_least_path():
    rng = np.random.default_rng(3)
    names = {0: "s", 1: "u", 2: "a", 3: "x"}
    valid = [x for x in range(16) if x & 12 != 12]
    for _ in range(60):
        codes = [bytes(rng.choice(valid, rng.integers(1, 9)).tolist()) for _ in range(20)]
        edits, states, costs = conversations.least_paths(codes, np.tile(conversations.CLOSING_COST, (len(codes), 1)))
        for c, e, s, cost in zip(codes, edits, states, costs):
            want = least_audit([names[x & 3] for x in c], [x & 4 > 0 for x in c], [x & 8 > 0 for x in c])
            assert (cost[0], e[0] + conversations.CLOSING[s[0]]) == want


def test_blocks_multiply_to_the_whole():
    rng = np.random.default_rng(4)
    a, b = bytes(rng.integers(0, 8, 30).tolist()), bytes(rng.integers(0, 8, 17).tolist())
    first, second, both = conversations.block_matrices([a, b, a + b])
    assert np.minimum((first[:, :, None] + second[None]).min(axis=1), conversations.FAR).tolist() == both.tolist()
