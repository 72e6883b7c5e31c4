"""Chat formatting and repair against plain walks over the same rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from meterlake.llm import chat, queries, repair

MARKS = "</s>[INST] ok [/INST]"
SCHEMA = "conv_id long, turn long, role string, text string, alive string, piece int, audit string, digest string, kind string"


@pytest.fixture(scope="module")
def odd_turns():
    """Nulls, ties, repeated rows, empty and long texts, marks in texts and roles."""
    g = random.Random(9)
    texts = [None, "", " ", "a. ", "Yes?", "no", "\t\n", MARKS, r"[\INST] <\\s>", "<", "[ROLE=x] ", "é 漢字!", "x" * 200_000, " "]
    rows = [(c, t, g.choice(["user", "assistant", "system", "tool", None, "", "a]\\", "User"]), g.choice(texts))
            for c in [*range(40), None] for t in [None, *range(g.randint(0, 9))]]
    rows += [(50, t // 2, "user", "same.") for t in range(6)] + [(51, 1, "user", "b."), (51, 1, "assistant", "a."), (52, -5, "system", "s."), (52, 9, "system", "s.")]
    rows += [(60, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(700)]
    return rows


@pytest.fixture(scope="module")
def odd_conversations(spark, odd_turns):
    return spark.createDataFrame([(*r, "n", 1, "K", "d", "k") for r in odd_turns], SCHEMA).repartition(5)


def in_order(rows, tie):
    def key(row):
        return (row[1] is not None, row[1] or 0, row[2], tie(row[3]))

    convs = sorted({r[0] for r in rows}, key=str)
    return {c: sorted((r for r in rows if r[0] == c), key=key) for c in convs}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("piece_chars", [chat.PIECE_CHARS, 1])
def test_round_trip(odd_conversations, odd_turns, piece_chars):
    pieces = chat.format_conversations(odd_conversations, piece_chars)
    found = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    plain = [(c, t, r or "", x or "") for c, t, r, x in odd_turns]
    expected = in_order(plain, str)
    assert set(found) == set(expected)
    for conv, rows in expected.items():
        if len({(r[1], r[2]) for r in rows}) < len(rows) and conv != 50:
            continue
        loss = "".join(r[3] for r in rows if r[2] == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(rows)
        assert row["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows)), conv
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
        assert row["formatted_chars"] >= sum(len(r[3]) for r in rows)
    stored = pieces.collect()
    assert sum(r["n_turns"] for r in stored) == len(odd_turns)
    if piece_chars == 1:
        assert all(r["n_turns"] == 1 for r in stored)
    else:
        assert sorted(r["piece"] for r in stored if r["conv_id"] == 60) == [0]


def test_rendered_turns():
    g = random.Random(1)
    atoms = ["[", "]", "<", ">", "/", "\\", "INST", "[INST]", "[/INST]", " [/INST]", "<s>", "</s>", "s", "ROLE=", "[/ROLE]", " ", "\n", "x"]
    for _ in range(4000):
        role, text = ("".join(g.choice(atoms) for _ in range(g.randint(0, n))) for n in (3, 8))
        role = g.choice(["user", "assistant", "system", role])
        turn = chat.render(role, text)
        assert chat.recovered(turn + turn) == [(role, text)] * 2
        assert chat.unescape(chat.escape(text)) == text
    assert chat.render("user", "plain [text] <b>") == "[INST] plain [text] <b> [/INST]"
    assert chat.render("user", MARKS) == r"[INST] <\/s>[\INST] ok [\/INST] [/INST]"
    for broken in ("x", "[INST] a", "<s>a [/INST]", "[INST] a[/INST]", "<s>a[INST] b</s>", "[INST][/INST]"):
        assert chat.recovered(broken) is None


def brute_edits(rows):
    """(cost, audit, repaired) by trying every sequence of edits, with all initials so far as state."""
    n = len(rows)
    layer = {(0, ""): [(0, "", ())]}
    for i in range(n + 1):
        for _ in range(3):  # insertions
            for (_, tail), paths in list(layer.items()):
                for cost, audit, out in list(paths):
                    if audit[-3:] == "III" or cost > 40:
                        continue
                    for name in ("user", "assistant"):
                        layer.setdefault((i, tail + name[0]), []).append((cost + 2, audit + "I", (*out, (name, ""))))
            layer = prune(layer)
        if i == n:
            break
        role, text, fault = rows[i]
        following = {}
        for (_, tail), paths in layer.items():
            for cost, audit, out in paths:
                following.setdefault((i + 1, tail), []).append((cost + 3, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if role:
                        following.setdefault((i + 1, tail + role[0]), []).append((cost + extra, audit + "K", (*out, (role, text))))
                    for name in ("user", "assistant"):
                        following.setdefault((i + 1, tail + name[0]), []).append((cost + 2 + extra, audit + "R", (*out, (name, text))))
        layer = prune(following)
    ends = [p for (_, tail), paths in layer.items() if re.fullmatch("(s?(ua)+)?", tail) for p in paths]
    return min(ends, key=lambda p: p[:2])


def prune(layer):
    """What can still be completed; of paths to equal initials all cheapest ones."""
    out = {}
    for (i, tail), paths in layer.items():
        if not re.fullmatch("s?(ua)*u?", tail):
            continue
        least = min(p[0] for p in paths)
        out[i, tail] = list({p for p in paths if p[0] <= least})
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ends = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (conv, turn, "user" if fate == 4 else role, text)
        yield row
        if fate == 3:
            yield row


def summary(rows):
    marked = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    count = {f: sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal), marked


def test_edits_are_cheapest_and_least():
    g = random.Random(5)
    kinds = list(itertools.product(["system", "user", "assistant", "tool", ""], ["", "blank", "truncated"]))
    for n in [0, 1, 1, 2, 2, *[3] * 30, *[4] * 40, *[5] * 40]:
        rows = [(g.choice(kinds)) for _ in range(n)]
        rows = [(role, f"text {k}", fault) for k, (role, fault) in enumerate(rows)]
        code = {"s": 1, "u": 2, "a": 3}
        given = bytes(code.get(r[0][:1], 0) + {"": 0, "blank": repair.GONE, "truncated": repair.CUT}[r[2]] for r in rows)
        cost, audit, _ = brute_edits(rows)
        assert repair.cheapest_edits(given) == (cost, audit), rows


def edited(marked, audit):
    """Repaired rows from the initials."""
    rows, out = iter(marked), []
    for edit in audit:
        forced = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((forced, ""))
            continue
        role, text, _ = next(rows)
        if edit != "D":
            out.append((role if edit == "K" else forced, text))
    return out


def test_repair_of_whole_rows(spark, odd_conversations, odd_turns):
    rows = repair.damaged(odd_conversations)
    found = {r["conv_id"]: r for r in repair.repair_report(rows, alive="alive").collect()}
    expected = in_order(list(hurt(odd_turns)), lambda t: hashlib.sha256(t.encode()).digest())
    assert set(found) == {r[0] for r in odd_turns}
    texts = {}
    for r in repair.repaired(rows, alive="alive").orderBy("place").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv in found:
        row = found[conv]
        counts, marked = summary(expected.get(conv, []))
        assert tuple(row)[1:6] == counts, conv
        out = edited(marked, row["audit"])
        assert sum(e in "DKR" for e in row["audit"]) == len(marked)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        lines = [f"{r}:{t}" for r, t in out]
        assert row["repaired_sha256"] == sha("\n".join(lines))
        assert texts.get(conv, []) == lines
        if len(marked) <= 6:
            assert (row["cost"], row["audit"]) == brute_edits(marked)[:2]


def test_lost_and_missing_conversations(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    row = repair.repair_report(repair.damaged(rows), alive="alive").first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", sha(""))
    empty = rows.where("false")
    assert repair.repair_report(empty).count() == 0 and repair.repaired(empty).count() == 0
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


def test_long_conversation_in_blocks():
    g = random.Random(2)
    rows = bytes(g.choice([1, 2, 3, 0, 2, 3, 6, 7, 10, 11]) for _ in range(5000))
    cost, audit = repair.cheapest_edits(rows)
    after = [repair._END]
    for row in reversed(rows):
        after.append(repair._before(row, after[-1]))
    assert cost == after[-1][0]
    assert sum(e != "I" for e in audit) == len(rows)


def test_queries_on_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    formatted = {r["conv_id"]: r for r in queries.QUERIES["op11_chat_format"](spark, folder).collect()}
    whole = in_order([*rows, (-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], str)
    assert set(formatted) == set(whole)
    for conv, turns in whole.items():
        assert formatted[conv]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in turns))
        assert formatted[conv]["loss_sha256"] == sha("".join(r[3] for r in turns if r[2] == "assistant"))
    fixed = {r["conv_id"]: r for r in queries.QUERIES["op13_conversation_repair"](spark, folder).collect()}
    left = in_order(list(hurt(rows)), str)
    assert set(fixed) == {r[0] for r in rows}
    for conv, row in fixed.items():
        counts, marked = summary(left.get(conv, []))
        assert tuple(row)[1:6] == counts
        assert row["repaired_sha256"] == sha("\n".join(f"{r}:{t}" for r, t in edited(marked, row["audit"])))
        if len(marked) <= 6:
            assert (row["cost"], row["audit"]) == brute_edits(marked)[:2]
