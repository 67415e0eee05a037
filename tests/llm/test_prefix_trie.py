"""The radix tree against a dictionary, and the trie against a plain one over rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusfit.llm import prefix_trie
from corpusfit.llm.radix_tree import RadixTree, aligned_depths

KIND = "conv_id long, turn long, role string, text string, node string"


def plain(rows):
    """Rows of all nodes, from dictionaries of tuples."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids[path])
    return sorted((
        min(own), len(path), min(members[path[:-1]]) if path else -1, len(own), len(kids[path]), leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()) for path, own in members.items())


def found(spark, rows, settings=prefix_trie.Settings()):
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in prefix_trie.nodes(frame, settings).collect())


def talk(seed, convs, most, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "hi", "Grüße 🙂"][:words]), "x")
            for c in convs for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("settings", [prefix_trie.Settings(), prefix_trie.Settings(segment=2, tree_nodes=30, packed_ids=3)])
def test_equals_a_plain_trie(spark, settings):
    rows = talk(1, [*range(0, 90), *range(100, 160), *range(250, 270)], 9, 3) + [(260, None, "user", "null turn first", "x")]
    rows += [(17, 1, "user", "tie", "x"), (17, 1, "assistant", "tie", "x"), (17, 1, "assistant", "tie", "x"), (None, 1, "user", "no conversation", "x")]
    assert found(spark, rows, settings) == plain(rows)


def test_hot_conversation_and_long_ones(spark):
    # Two equal long conversations, many equal short ones, ids whose base is absent.
    rows = [(c, t, "user", f"turn {t}", "x") for c in (3000, 3100) for t in range(60)]
    rows += [(c, t, "user", f"same {t}", "x") for c in range(4000, 4120) for t in range(4)]
    assert found(spark, rows, prefix_trie.Settings(segment=7, packed_ids=10)) == plain(rows)


def test_empty_table_and_single_turns(spark):
    assert found(spark, []) == []
    rows = [(c, 0, None, None, None) for c in range(12)]
    assert found(spark, rows) == plain(rows)


def test_role_and_text_do_not_run_together(spark):
    rows = [(c, t, role, text, "x") for c, role, text in ((0, "a", "bc"), (1, "ab", "c"), (2, "a", "bc")) for t in range(7)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("letters", [2, 12, 40, 256])
def test_tree_equals_a_dictionary(letters):
    rng = random.Random(letters)
    keys = [bytes(rng.randrange(letters) for _ in range(2 * rng.randrange(0, 5))) for _ in range(3000)]
    tree, want = RadixTree(lambda x, y: x + y), defaultdict(int)
    for key in keys:
        tree.insert(key, 1)
        for d in range(0, len(key) + 1, 2):
            want[key[:d]] += 1
    assert dict(aligned_depths(tree, 2, lambda x, y: x + y)) == want
    ends = {key: node.value for key, node, _, _ in tree.walk() if node.value}
    assert ends == {k: keys.count(k) for k in set(keys)} and sum(tree.layouts().values()) == tree.nodes
    used = {name for name, n in tree.layouts().items() if n}
    assert used >= {2: {"Node4"}, 12: {"Node16"}, 40: {"Node48"}, 256: {"Node256"}}[letters]


def test_paths_are_compressed():
    tree = RadixTree(lambda x, y: x + y)
    tree.insert(b"\x00" * 4000, 1)
    tree.insert(b"\x00" * 3998 + b"\x01\x01", 1)
    assert tree.nodes <= 4 and sum(1 for _ in aligned_depths(tree, 2, lambda x, y: x + y)) == 2002
