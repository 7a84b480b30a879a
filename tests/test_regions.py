"""Findings merged up the tree, against the rule followed lineage by lineage."""

import random

from cloneforge.operators import regions, trees

FOUND = "cell string, depth int, region string, score double, pvalue double, adjustp double"


def one_by_one(rows, up, eligible, depth, hang):
    """The rule for one region and direction. up: child -> parent."""

    def path(c):
        out = [c]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out

    below = lambda c: [x for x in eligible if c in path(x)[1:]]
    live = {r[0]: r for r in sorted(rows, key=lambda r: (r[1], r[0]))}
    kept = []
    for r in list(live.values()):
        if r[0] not in live:
            continue
        sub = [x for x in live.values() if r[0] in path(x[0])]
        lacks = [depth[c] for c in below(r[0]) if c not in live]
        late = [x for x in sub if lacks and x[1] >= min(lacks)]
        kept.append(late[0] if len(sub) > 1 and late else r)
        for x in sub:
            del live[x[0]]
    found = {r[0]: list(r) for r in kept}
    if len(found) > 1:
        while True:
            for c in list(found):
                if any(a in found for a in path(c)[1:]):
                    del found[c]
            by = {}
            for c in found:
                if len(path(c)) > 2:
                    by.setdefault(up[c], []).append(c)
            by = {p: cs for p, cs in by.items() if len(cs) > 1}
            if not by:
                break
            for p, cs in by.items():
                own = [found.pop(c) for c in cs]
                found[p] = [p, own[0][1] - 1, own[0][2], *(sum(x[k] for x in own) / len(own) for k in (3, 4, 5))]
        if all(len(path(c)) <= 2 for c in found) and hang <= len(found):
            found = {}
    return {(c, r[1], r[2], round(r[3], 9), round(r[4], 9), round(r[5], 9)) for c, r in found.items()}


def test_refined_is_the_rule_lineage_by_lineage(spark):
    for seed in range(3):
        rng = random.Random(seed)
        up = {f"c{k}": f"c{rng.randrange(max(0, k - 4), k)}" for k in range(1, 40)}
        depth = {"c0": 0}
        for c, p in up.items():
            depth[c] = depth[p] + 1
        tree = spark.createDataFrame([(p, c, 1) for c, p in up.items()], "parent string, child string, dist long")
        eligible = {c for c in up if rng.random() < 0.8}
        rows = []
        for k in range(12):  # regions that few or most lineages have, of both directions
            share = rng.choice([0.1, 0.4, 0.8, 1.0])
            rows += [(c, depth[c], f"1:p{k}", s * rng.randrange(1, 9) / 4, 0.01, 0.02) for c in sorted(eligible) for s in (1, -1) if rng.random() < share]
        closed = trees.closure(tree)
        lineage = spark.createDataFrame([(c, depth[c]) for c in eligible], "cell string, depth int")
        got = {(r.cell, r.depth, r.region, round(r.score, 9), round(r.pvalue, 9), round(r.adjustp, 9)) for r in regions.refined(spark.createDataFrame(rows, FOUND), closed, tree, lineage).collect()}
        hang = sum(up[c] == "c0" for c in eligible)
        want = set()
        for region in {r[2] for r in rows}:
            for s in (1, -1):
                want |= one_by_one([r for r in rows if r[2] == region and r[3] * s > 0], up, eligible, depth, hang)
        assert got == want and want


def test_nothing_found(spark):
    tree = spark.createDataFrame([("r", "a", 1)], "parent string, child string, dist long")
    assert regions.refined(spark.createDataFrame([], FOUND), trees.closure(tree), tree, spark.createDataFrame([("a", 1)], "cell string, depth int")).collect() == []
