"""Brute-force neighbours and scores with numpy, for fixtures of a few thousand points."""

import numpy as np


def rnd(v, scale):
    return v if scale is None else np.floor(v * 10.0**scale + 0.5) / 10.0**scale


def brute_force(ids, xs, p):
    """{id: (neighbour ids, distances, kdist, lcf, nof)}"""
    if not len(ids):
        return {}
    ids, xs = np.asarray(ids), np.asarray(xs, dtype=float).reshape(len(ids), -1)
    order = np.argsort(ids)
    ids, xs = ids[order], xs[order]
    near, lcf = [], []
    for i in range(len(ids)):
        gap = xs[i] - xs
        total = np.zeros(len(ids))
        for j in range(xs.shape[1]):
            total += np.abs(gap[:, j]) if p.metric == "l1" else gap[:, j] * gap[:, j]
        d = rnd(total if p.metric == "l1" else np.sqrt(total), p.dist_scale)
        d[i] = np.inf
        at = np.argsort(d, kind="stable")[: min(p.k, len(ids) - 1)]
        net = []
        for j in range(xs.shape[1]):
            f = (xs[i, j] - xs[at, j]) * (d[at] * d[at])
            if p.force_scale is not None:
                f = np.floor(f * 10.0**p.force_scale + 0.5)
            s = sum(f.tolist())
            net.append(s if p.force_scale is None else s / 10.0**p.force_scale)
        s = 0.0
        for v in net:
            s += v * v
        near.append((at, d[at]))
        lcf.append(float(rnd(np.sqrt(s), p.lcf_scale)))
    lcf = np.array(lcf)
    out = {}
    for i, (at, d) in enumerate(near):
        if lcf[i] <= 1e-9:
            nof = 0.0
        elif p.lcf_scale is None:
            nof = float(rnd(lcf[at].sum() / p.k, p.nof_scale))
        else:
            unit = 10.0**p.lcf_scale
            total = np.floor(lcf[at] * unit + 0.5).sum() / unit
            nof = float(rnd(total / p.k, p.nof_scale))
        kdist = float(d[-1]) if len(d) else None
        out[int(ids[i])] = (ids[at].tolist(), d.tolist(), kdist, float(lcf[i]), nof)
    return out
