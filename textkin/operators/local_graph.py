"""Graph kernels for the rows of one task: spanning forests and communities."""

import pyarrow as pa

#: Edges that one forest spans; a task with more makes several.
FOREST_EDGES = 200_000


def forest(batches):
    """Links ``(u, v)`` from every node to the smallest node that edges of this task connect it with."""

    def links(parent, schema):
        out = []
        for x in parent:
            top = x
            while parent[top] != top:
                top = parent[top]
            if top != x:
                out.append((x, top))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], schema.field(n).type) for k, n in enumerate(("u", "v"))], ["u", "v"])

    parent, seen, schema = {}, 0, None
    for batch in batches:
        schema = batch.schema
        for ends in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            tops = []
            for x in ends:
                parent.setdefault(x, x)
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                tops.append(x)
            if tops[0] != tops[1]:
                parent[max(tops)] = min(tops)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield links(parent, schema)
            parent, seen = {}, 0
    if parent:
        yield links(parent, schema)


def _parts(members, near):
    """Connected parts of a set of nodes."""
    left = set(members)
    while left:
        part = [left.pop()]
        for x in part:
            for y in near[x]:
                if y in left:
                    left.remove(y)
                    part.append(y)
        yield part


def communities(src, dst, weight, m2: float, resolution=1.0) -> dict:
    """Community of every node, named by its smallest member, for a part of a graph whose edges weigh ``m2 / 2`` in all.

    Nodes move, in order, to the neighbouring community with the largest gain of modularity until none gains; communities
    that fell apart on the way are split into their connected parts, and become the nodes of the next level.
    """
    ids = sorted(set(src) | set(dst))
    place = {x: i for i, x in enumerate(ids)}
    near, degree = [{} for _ in ids], [0.0] * len(ids)
    for a, b, w in zip(src, dst, weight):
        a, b = place[a], place[b]
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
        degree[a] += w
        degree[b] += w
    belongs = list(range(len(ids)))
    while True:
        n = len(near)
        of, total, moved = list(range(n)), degree[:], True
        while moved:
            moved = False
            for x in range(n):
                links = {}
                for y, w in near[x].items():
                    links[of[y]] = links.get(of[y], 0.0) + w
                own, k = of[x], degree[x]
                total[own] -= k
                best, gain = own, links.get(own, 0.0) - resolution * k * total[own] / m2
                for c in sorted(links):
                    other = links[c] - resolution * k * total[c] / m2
                    if other > gain + 1e-12:
                        best, gain = c, other
                total[best] += k
                if best != own:
                    of[x], moved = best, True
        groups = {}
        for x, c in enumerate(of):
            groups.setdefault(c, []).append(x)
        parts = sorted((sorted(p) for g in groups.values() for p in _parts(g, near)), key=lambda p: p[0])
        if len(parts) == n:
            break
        number = {x: i for i, p in enumerate(parts) for x in p}
        joined = [{} for _ in parts]
        for x in range(n):
            for y, w in near[x].items():
                if number[x] != number[y]:
                    joined[number[x]][number[y]] = joined[number[x]].get(number[y], 0.0) + w
        belongs = [number[b] for b in belongs]
        degree = [sum(degree[x] for x in p) for p in parts]
        near = joined
    name = {}
    for x, c in zip(ids, belongs):
        name.setdefault(c, x)  # ids are sorted
    return {x: name[c] for x, c in zip(ids, belongs)}
