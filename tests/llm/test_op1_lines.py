import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessella.llm import op1_lines as m


def pattern(line):
    """Words of a line with its variable fields as wildcards; short lines, and those of fields alone, stay as they are."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
    fields = [re.search("[0-9@]", w) is not None for w in words]
    whole = len(words) < m.DEPTH or len(words) < 2 * m.DEPTH and all(fields)
    return tuple("<*>" if f and not whole else w for w, f in zip(words, fields))


def brute(rows, min_docs):
    """The rule in plain Python, on words instead of hashes, every template against every group of its leaf; text by (id, text)."""
    lines = []
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x)):
        for no, line in enumerate(text.split("\n")):
            if words := pattern(line):
                lines.append((doc, text, no, words))
    leaves = defaultdict(Counter)
    for *_, w in lines:
        leaves[len(w), w[: m.DEPTH]][w] += 1
    group = {}
    for leaf, templates in leaves.items():
        made = []
        for words, _ in sorted(templates.items(), key=lambda x: (-x[1], x[0])):
            hit = None
            for g in made:
                share = sum(a == b and f for a, b, f in zip(g["first"], words, g["fixed"])) / len(words)
                if share >= m.SIMILARITY and (hit is None or share > hit[0]):
                    hit = (share, g)
            if hit is None:
                hit = (1, {"first": words, "fixed": [True] * len(words)})
                made.append(hit[1])
            g = hit[1]
            g["fixed"] = [f and a == b for f, a, b in zip(g["fixed"], g["first"], words)]
            group[words] = (leaf, g["first"])
    members = defaultdict(list)
    for line in lines:
        members[group[line[3]]].append(line)
    gone = defaultdict(set)
    for (leaf, _), own in members.items():
        if len({x[:2] for x in own}) >= (min(min_docs, m.LONG_DOCS) if leaf[0] >= m.LONG_TOKENS else min_docs):
            # The first line of the first document stays.
            for d, t, no, _ in own[1:]:
                gone[d, t].add(no)
    return {(d, t or ""): "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d, t or ""]) for d, t in rows}


def corpus():
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    stamped = "Posted on {} by user{} in the general news section today"
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(5)]
        if i % 2:
            lines.insert(rng.randrange(5), stamped.format(i, i * 7))
        if i % 3 == 0:
            lines += ["All rights reserved under the terms of license agreement", "", "Short line", f"Page {i}", f"{i} {i + 1} {i + 2}", " ".join(["Long"] * 60)]
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "z", len(b)) for a, b in rows], "doc_id long, text string, leaf string, n_chars long")
    want = brute(rows, 3)
    out = m.mark(docs, 3).collect()
    assert len(out) == 60 and sum(r.dropped_lines for r in out) > 40
    for r in out:
        assert r.text == want[r.doc_id, dict(rows)[r.doc_id]] and r.leaf == "z" and (r.n_chars == len(r.text))


def test_edges(spark):
    line = "this very line is in all the documents"
    rows = [(1, None), (2, ""), (3, line), (4, line), (5, line + "\n" + "w " * 100000), (6, "\n\n" + line), (None, line), (7, "own words here"), (7, "own words here"), (8, line + "\n" + line)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, drop int")
    out = sorted((str(r.doc_id), r.text) for r in m.dedup(docs, 3).collect())
    # The null id sorts first and keeps the line.
    assert [x[0] for x in out] == ["1", "2", "5", "7", "7", "None"] and dict(out)["1"] is None and dict(out)["None"] == line
    assert m.dedup(docs.limit(0)).count() == 0 and m.dedup(docs).columns == docs.columns


def test_leaf_merges_variable_fields():
    leaf = m.Leaf()
    a = np.arange(1, 13, dtype=np.uint16)
    b, c = a.copy(), a.copy()
    b[5], c[5], c[9] = 99, 98, 97
    assert [leaf.add(1, a), leaf.add(2, b), leaf.add(3, c), leaf.add(4, a[::-1].copy())] == [1, 1, 1, 4]
    assert leaf.fixed[0].sum() == 10


def test_short_lines_and_long_lines_in_two_documents(spark):
    rng = random.Random(5)
    long, less = (" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n)) for n in (50, 49))
    rows = []
    for i in range(6):
        own = f"own{'abcdef'[i] * 3}"
        lines = [own, "All rights reserved.", "the end", "Page 7", f"Page 1{i}", f"1{i} 2{i} 3{i}", f"Posted on day {i}"]
        rows.append((i, "\n".join(lines + [long, less] * (i in (2, 4)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in m.mark(docs).collect()}
    assert got[0] == rows[0][1].split("\n")
    for i in range(1, 6):
        # Lines of fewer words than the tree is deep, or of variable fields alone, are held against equal ones only.
        want = [f"own{'abcdef'[i] * 3}", f"Page 1{i}", f"1{i} 2{i} 3{i}"]
        assert got[i] == want + [long] * (i == 2) + [less] * (i in (2, 4))


def test_leaf_finds_groups_as_a_full_comparison_does():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 5, 6, 16, 23, 40, 120):
        leaf, made = m.Leaf(), []
        bases = rng.integers(1, 9, (4, n)).astype(np.uint16)
        bases[:, : m.DEPTH] = bases[0, : m.DEPTH]
        for i in range(200):
            words = bases[rng.integers(4)].copy()
            at = m.DEPTH + rng.permutation(max(0, n - m.DEPTH))[: rng.integers(0, n // 4 + 2)]
            words[at] = rng.integers(9, 99, len(at))
            shares = [((g[1] == words) & g[2]).mean() for g in made]
            best = int(np.argmax(shares)) if shares else -1
            if best >= 0 and shares[best] >= m.SIMILARITY:
                made[best][2] &= made[best][1] == words
            else:
                best = len(made)
                made.append([i, words, np.ones(n, bool)])
            assert leaf.add(i, words) == made[best][0], (n, i)


def test_leaf_takes_changes_in_every_quarter():
    a = np.arange(1, 41, dtype=np.uint16)
    b = a.copy()
    b[[5, 15, 25, 35]] = 99
    leaf = m.Leaf()
    assert [leaf.add(1, a), leaf.add(2, b)] == [1, 1]
