"""Rows of whole queries against plain versions: byte-pair coding, chat repair and URL rules."""

import hashlib
import itertools
import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from dockmill.llm import bpe, chat, url_filter
from dockmill.llm.common import table
from tests.llm.test_other_operators import brute_parts, brute_rule

SF = "/root/testdata/sf0.001"


def sha(said):
    return hashlib.sha256(said.encode("utf-8")).hexdigest()


def test_op9_rows_equal_the_library(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.no_truncation()
    coder.no_padding()
    want = []
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op9_bpe(spark, SF).collect())) == sorted(want)


NAMES = {1: "system", 2: "user", 3: "assistant"}
FOLLOWS = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}


def step(own, before, after):
    """The cheapest way to go on with a turn: cost, kind (0 as it comes, 1 merged, 2 behind an empty turn), role of that turn."""
    named = 0 if own == after else 4 if own else 1
    ways = [(named, 0, 0)] if after in FOLLOWS[before] else []
    ways += [(2 + named, 1, 0)] if before == after else []
    ways += [(5 + named, 2, x) for x in (2, 3) if x in FOLLOWS[before] and after in FOLLOWS[x]]
    return min(ways, default=None)


def brute_repair(turns):
    """(rows without ids, formatted text) of the cheapest of all state sequences, ties by the last state and then by the smallest states from the end."""
    best = None
    for states in itertools.product((1, 2, 3), repeat=len(turns)):
        cost, before = 0, 0
        for (_, role, _), after in zip(turns, states):
            way = step(chat.own_role(role), before, after)
            if way is None:
                break
            cost, before = cost + way[0], after
        else:
            key = (cost, states[-1] == 1, -states[-1], states[::-1][1:])
            best = min(best or (key, states), (key, states))
    rows, spoken, before = [], [], 0
    for (turn, role, text), after in zip(turns, best[1]):
        _, kind, inserted = step(chat.own_role(role), before, after)
        clean = (text or "").replace("<|", "< |")
        if inserted:
            rows.append((len(rows), len(spoken), None, NAMES[inserted], None, "insert", ""))
            spoken.append([NAMES[inserted], []])
        if kind == 1:
            spoken[-1][1].append(clean)
            action = "merge"
        else:
            spoken.append([NAMES[after], [clean]])
            action = "relabel" if chat.own_role(role) != after else "keep"
        rows.append((len(rows), len(spoken) - 1, turn, NAMES[after], role, action, text or ""))
        before = after
    return rows, "".join(f"<|{role}|>\n" + "\n".join(texts) + "<|end|>\n" for role, texts in spoken)


def compare(got, conversations):
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for key, turns in conversations.items():
        rows = sorted(by[key], key=lambda r: r.ordinal)
        want, said = brute_repair(turns)
        assert [(r.ordinal, r.position, r.turn, r.role, r.original_role, r.action, r.text) for r in rows] == want, turns
        assert "".join(r.rendered for r in rows) == said


def test_op10_actions_and_texts(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "Human", " GPT ", "tool", None, "developer"]
    conversations = {k: [(t, rng.choice(roles), rng.choice(["a", "<|x|>", "", None, "two\nlines"])) for t in range(rng.randrange(1, 7))] for k in range(250)}
    conversations[900] = [(0, "assistant", "x" * 500_000), (1, "assistant", "<|" * 1000)]
    df = spark.createDataFrame([(k, *t, "s") for k, turns in conversations.items() for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    compare(chat.repair_conversations(df).collect(), conversations)


def test_op10_query(spark):
    conversations = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        conversations[r.conv_id].append((r.turn, r.role, r.text))
    short = {k: t for k, t in conversations.items() if len(t) <= 8 and len({x[0] for x in t}) == len(t)}
    got = chat.op10_chat_format(spark, SF).collect()
    assert len(short) > 10 and {r.conv_id for r in got} == {*conversations}
    compare(got, short)


def test_op4_query(spark):
    pages = table(spark, SF, "pages").select("page_id", "url").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op4_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for r in pages:
        host, path = brute_parts(r.url)
        rule, verdict = brute_rule(host, path)
        assert got[r.page_id][:3] == (host, path, rule)
        assert got[r.page_id][3] == (verdict or "allow")  # no mined rule has the pages it needs here
