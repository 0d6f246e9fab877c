"""Pyramid features and the staged boost against a plain numpy account."""

import numpy as np
import pytest

from sparkmere.operators import boost, pyramid, tags

DIMS, TAGS = 12, 45


def handshake(query, vectors):
    deltas = [query - v for v in vectors]
    directions = [d / np.linalg.norm(d) if np.linalg.norm(d) > 1e-9 else d * 0 for d in deltas]
    pairs = [abs(directions[i] @ directions[j]) for i in range(min(5, len(vectors))) for j in range(i + 1, min(5, len(vectors)))]
    return [np.linalg.norm(d) for d in deltas], np.linalg.norm(np.mean(directions, axis=0)), np.mean(pairs) if pairs else 0.0


def plain_levels(query, vectors, priors):
    rest, whole, used, out = query.astype(float), float(query @ query), set(), []
    for level in range(3 if whole >= 1e-12 else 0):
        sims = {k: v @ rest / np.linalg.norm(v) / np.linalg.norm(rest) for k, v in vectors.items() if k not in used and np.linalg.norm(v) > 1e-9}
        near = sorted(sims, key=lambda k: (-sims[k] * priors.get(k, 1.0), k))[:10]
        if not near:
            break
        basis, coefficients = [], []
        for k in near:
            v = vectors[k].astype(float).copy()
            for u in basis:
                v -= (v @ u) * u
            if np.linalg.norm(v) > 1e-6:
                basis.append(v / np.linalg.norm(v))
                coefficients.append(abs(rest @ basis[-1]))
            else:
                coefficients.append(0.0)
        left = rest - sum((rest @ u) * u for u in basis)
        shake = handshake(query, [vectors[k] for k in near]) if level == 0 else None
        out.append({"near": near, "sims": [sims[k] for k in near], "coefficients": coefficients, "explained": max(0.0, (rest @ rest - left @ left) / whole), "residual": left @ left / whole, "shake": shake})
        used |= set(near)
        rest = left
        if out[-1]["residual"] < 0.1:
            break
    return out


def plain_features(levels):
    cover = min(1.0, max(0.0, sum(x["explained"] for x in levels)))
    _, direction, strength = levels[0]["shake"]
    return len(levels), cover, 0.7 * (1 - cover) + 0.3 * direction, strength, max(0.0, cover * strength * (1 - (1 - direction) * (1 - strength)))


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(12)
    vectors = {k: rng.normal(size=DIMS) for k in range(1, TAGS)}
    vectors[3] = vectors[2] * 1.5 + 0.01
    vectors[44] = np.zeros(DIMS)
    names = {k: f"{'冰箱' if k % 3 else 'usb-hub'} {k}" for k in vectors}
    edges = [(int(a), int(b), float(round(w, 3))) for a, b, w in {(a, b): (a, b, w) for a, b, w in zip(rng.integers(1, 60, 400), rng.integers(1, 60, 400), rng.uniform(0.1, 1.6, 400)) if a != b}.values()]
    priors = {k: float(p) for k, p in zip(range(1, 30), rng.uniform(0.5, 1.0, 29))}
    queries = {q: rng.normal(size=DIMS) for q in (1, 2, 3, 4)} | {5: np.zeros(DIMS), 6: vectors[7] * 2.0}
    axes, mean = np.linalg.qr(rng.normal(size=(DIMS, DIMS)))[0][:6], rng.normal(size=DIMS) * 0.1
    return vectors, names, edges, priors, queries, axes, mean


def frames(spark, world):
    vectors, names, edges, priors, queries, _, _ = world
    return (
        spark.createDataFrame([(q, v.tolist()) for q, v in queries.items()], "query_id long, vector array<double>"),
        spark.createDataFrame([(k, names[k], v.tolist()) for k, v in vectors.items()], "tag long, name string, vector array<double>"),
        spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(list(priors.items()), "tag long, residual double"),
    )


def test_features(spark, world):
    vectors, _, _, priors, queries, _, _ = world
    asked, rows, _, residuals = frames(spark, world)
    levels = pyramid.pyramid_levels(asked, rows.withColumnRenamed("tag", "node_id").drop("name"), residuals)
    found = {(r.query_id, r.level): r for r in levels.collect()}
    for q, v in queries.items():
        want = plain_levels(v, vectors, priors)
        assert len(want) == sum(k[0] == q for k in found)
        for k, x in enumerate(want):
            r = found[q, k]
            assert r.tags == x["near"] and np.allclose(r.sims, x["sims"]) and np.allclose(r.coefficients, x["coefficients"]) and np.allclose([r.residual, r.explained], [x["residual"], x["explained"]])
            assert k or np.allclose([*r.magnitudes, r.coherence, r.strength], [*x["shake"][0], *x["shake"][1:]])
    told = {r.query_id: tuple(r)[1:] for r in pyramid.pyramid_features(levels).collect()}
    assert set(told) == set(queries) - {5} and all(np.allclose(told[q], plain_features(plain_levels(queries[q], vectors, priors))) for q in told)


def plain_boost(world, q, core, ghosts, base, labels):
    vectors, names, edges, priors, queries, axes, mean = world
    query = queries[q]
    levels = plain_levels(query, vectors, priors)
    if not levels:
        return query, "no_seeds", 0.0, 0, 0, 0, 0, []
    energy = (axes @ (query - mean)) ** 2
    p = energy / energy.sum()
    entropy = -sum(x * np.log2(x) for x in p if x > 0) / np.log2(len(axes))
    depth, label = max(0.0, 1 - entropy), labels[int(np.argmax(p))]
    top = sorted(p, reverse=True)
    resonance = sum(b for b in (np.sqrt(top[0] * x) for x in top[1:]) if b > 0.15)
    _, cover, _, _, activation = plain_features(levels)
    factor = 1.2 + min(1, max(0, 0.5 * depth + 0.5 * (1 - cover))) * 0.2

    def penalty(name):
        noise = name.isascii() and len(name) > 3
        if label not in ("", "Unknown") and label.isascii() and " " not in label and "&" not in label:
            return 1.0
        return 1.0 if not noise else 0.4 if label in ("", "Unknown") else 0.3

    seeds = {}
    for k, level in enumerate(levels):
        for tag, sim, c in zip(level["near"], level["sims"], level["coefficients"]):
            w = c * 0.7**k * penalty(names[tag]) * (factor * (0.95 + 0.1 * min(1, max(0, sim))) if names[tag] in core else 1.0)
            if w > 0:
                seeds.setdefault(tag, w)
    synapses = {}
    for a, b, w in edges:
        synapses.setdefault(a, []).append((b, w))
    energies, active = dict(seeds), {t: (w, 2.0) for t, w in seeds.items()}
    for _ in range(4):
        following = {}
        for a, (e, m) in active.items():
            if e < 0.1 or m < 0:
                continue
            for b, w in sorted(synapses.get(a, []), key=lambda x: (-x[1], x[0]))[:20]:
                hole = w * priors.get(b, 1.0) >= 1
                sent, left = e * w * (0.7 if hole else 0.25), m - (0 if hole else 1)
                if sent >= 0.01 and (left >= 0 or hole):
                    old = following.get(b, (0.0, -9.0))
                    following[b] = (old[0] + sent, max(old[1], left))
        for b, (e, _) in following.items():
            energies[b] = energies.get(b, 0.0) + e
        active = following
    held = {t: max(w, energies[t]) for t, w in seeds.items()}
    emergent = sorted((-e, t) for t, e in energies.items() if t not in seeds and t in vectors)[:50]
    rows = [(t, w, vectors[t]) for t, w in held.items()] + [(t, -e, vectors[t]) for e, t in emergent]
    n_seeds, n_emergent = len(held), len(emergent)
    present, most = {names[t] for t, _, _ in rows}, max(w for _, w, _ in rows)
    added = [(t, most, vectors[t]) for t in vectors if names[t] in core and names[t] not in present]
    rows += added
    fitting = [g for g in ghosts if len(g[1]) == DIMS]
    rows += [(-1 - k, most if hard else most / factor, np.array(v)) for k, (hard, v) in enumerate(fitting)]
    kept = []
    for t, w, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        length = np.linalg.norm(v)
        into = next((k for k in kept if length > 1e-9 and np.linalg.norm(k[2]) > 1e-9 and k[2] @ v / length / np.linalg.norm(k[2]) > 0.88), None)
        if into:
            into[1] += 0.2 * w
        else:
            kept.append([t, w, v])
    total = sum(w for _, w, _ in kept)
    context = sum(v * w / total for _, w, v in kept)
    dynamic = depth * (1 + np.log(1 + resonance)) / (1 + 0.5 * entropy) * (0.5 + min(1, activation))
    alpha = min(1.0, max(0.0, base * min(2.0, max(0.3, dynamic))))
    if alpha <= 0:
        return query, "zero_alpha", 0.0, n_seeds, n_emergent, len(added), len(fitting), [k[0] for k in kept]
    mixed = (1 - alpha) * query + alpha * context / np.linalg.norm(context)
    return mixed / np.linalg.norm(mixed), None, alpha, n_seeds, n_emergent, len(added), len(fitting), [k[0] for k in kept]


@pytest.mark.parametrize(("base", "labels"), [(0.5, ["Unknown"] * 6), (0.8, ["home & garden", "Tech", "Unknown", "Tech", "x y", "冰箱"]), (0.0, ["Tech"] * 6)])
def test_staged_boost(spark, world, base, labels):
    vectors, names, _, _, queries, axes, mean = world
    asked, rows, cooc, residuals = frames(spark, world)
    core = {1: {names[9], names[44]}, 2: {names[21], "nowhere"}, 5: {names[1]}}
    ghosts = {1: [(True, vectors[5].tolist()), (False, [1.0]), (False, (-vectors[5]).tolist())], 3: [(False, vectors[2].tolist())], 5: [(True, vectors[5].tolist())]}
    core_rows = spark.createDataFrame([(q, n) for q, own in core.items() for n in own], "query_id long, tag string")
    ghost_rows = spark.createDataFrame([(q, [{"hard": h, "vector": v} for h, v in own]) for q, own in ghosts.items()], "query_id long, ghosts array<struct<hard: boolean, vector: array<double>>>")
    found = boost.apply_tag_boost(asked, rows, cooc, (axes, mean), labels, base, core_rows, ghost_rows, residuals, resonant=True).collect()
    assert len(found) == len(queries)
    for r in found:
        vector, reason, alpha, seeds, emergent, added, n_ghosts, matched = plain_boost(world, r.query_id, core.get(r.query_id, set()), ghosts.get(r.query_id, []), base, labels)
        assert (r.reason, r.seeds, r.emergent, r.core_added, r.ghosts, r.matched) == (reason, seeds, emergent, added, n_ghosts, matched)
        assert np.allclose(r.vector, vector) and abs(r.alpha - alpha) < 1e-9


def test_skipped(spark, world):
    asked, rows, cooc, _ = frames(spark, world)
    basis = world[5], world[6]
    for given, reason in ((dict(cooc=cooc.limit(0), tag_rows=rows), "matrix_missing"), (dict(cooc=cooc, tag_rows=rows.limit(0)), "no_tag_vectors")):
        found = boost.apply_tag_boost(asked, basis=basis, labels=["x"] * 6, **given).collect()
        assert len(found) == 6 and {r.reason for r in found} == {reason}
    odd = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, vector array<double>")
    assert {r.reason for r in boost.apply_tag_boost(odd, rows, cooc, basis, ["x"] * 6).collect()} == {"no_seeds"}


def test_axis_labels(spark):
    rows = spark.createDataFrame([(1, "right", [2.0, 0.1]), (2, "down", [0.0, -1.0]), (3, "zero", [0.0, 0.0])], "node_id long, name string, vector array<double>")
    assert pyramid.axis_labels(np.eye(2), rows) == ["right", "down"] and pyramid.axis_labels(np.eye(2), rows.limit(0)) == ["Unknown", "Unknown"]
    assert tags.LEAST  # the spike's constants are the boost's
