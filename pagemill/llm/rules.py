"""Ordered rule lists by incremental reduced-error pruning, exported as SQL CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Below this many positive examples a held-out third says nothing: rules are then pruned on all examples.
FEW = 12
#: A rule needs so many positive examples, and such a share of its label's (one less where they are few), and two more for
#: each condition after the first: wrong labels make no rule.
SUPPORT, SUPPORT_SHARE = 3, 0.03
#: The least (p - n) / (p + n) of a rule over all examples that are left.
WORTH = 0.5
#: The share of wrong labels that a rule may cover, one at least: growing stops there, and pruning drops what only removes so many.
NOISE = 0.05
#: Gains that differ by this share are alike; the wider gap decides.
NEAR = 0.05
#: Where growing finds no rule, one example alone makes one if it lies this share of the column's range away from all other labels.
FAR = 0.25
#: Splits tried before a label has no further rule.
TRIES = 5


@dataclass(frozen=True)
class Condition:
    column: str
    below: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.column} {'<=' if self.below else '>'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def covers(conditions, names: list[str], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.column)]
        hit &= v <= c.threshold if c.below else v > c.threshold
    return hit


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str], scale: np.ndarray, support: int, used: set[str]) -> Condition | None:
    """The condition on an unused column of the highest information gain; of nearly equal ones that with the widest gap at its threshold."""
    pos, neg = y.sum(), (~y).sum()
    base = np.log2(pos / (pos + neg))
    best, found = 1e-9, None
    for j, name in enumerate(names):
        if name in used:
            continue
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        gap = (v[at + 1] - v[at]) / scale[j]
        p, n = np.cumsum(t)[at], np.cumsum(~t)[at]
        for below, pp, nn in ((True, p, n), (False, pos - p, neg - n)):
            gain = np.where(pp >= support, pp * (np.log2(np.maximum(pp, 1e-12) / (pp + nn)) - base), -1.0)
            top = gain.max()
            if top <= 0:
                continue
            k = np.flatnonzero(gain >= (1 - NEAR) * top)
            k = k[np.argmax(gap[k])]
            worth = float(gain[k] * (1 + NEAR * min(1.0, 4 * gap[k])))
            if worth > best:
                best, found = worth, Condition(name, below, float((v[at[k]] + v[at[k] + 1]) / 2))
    return found


def _grow(x, y, names, scale, longest: int, support: int) -> list[Condition]:
    rule, live = [], np.ones(len(x), bool)
    while len(rule) < longest and (~y[live]).sum() > (max(1, NOISE * y[live].sum()) if rule else 0) and y[live].any():
        c = _best_condition(x[live], y[live], names, scale, support, {c.column for c in rule})
        if c is None:
            break
        rule.append(c)
        live &= covers([c], names, x)
    return rule


def _worth(rule, names, x, y) -> tuple[float, int]:
    hit = covers(rule, names, x)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def _outlier(x, y, names, scale) -> list[Condition]:
    """A condition that holds for no other label: for SUPPORT examples, or for fewer with a gap of FAR of the column's range."""
    best, rule = (0, 0.0), []
    for j, name in enumerate(names):
        v, o = x[y, j], x[~y, j]
        if not len(o):
            continue
        for below, out, edge in ((True, v[v < o.min()], o.min()), (False, v[v > o.max()], o.max())):
            if len(out):
                near = out.max() if below else out.min()
                wide = abs(edge - (out.min() if below else out.max())) / scale[j]
                if (len(out) >= SUPPORT or wide > FAR) and (len(out), wide) > best:
                    best, rule = (len(out), wide), [Condition(name, below, float((edge + near) / 2))]
    return rule


def learn(x: np.ndarray, labels: list[str], names: list[str], default: str, seed: int = 7, longest: int = 4) -> list[Rule]:
    """Rules for each label but the default one, rarest label first; of each, rules until one is wrong more often than right."""
    y_all = np.array(labels, object)
    live = np.ones(len(x), bool)
    scale = np.maximum(x.max(0) - x.min(0), 1e-12) if len(x) else np.ones(len(names))
    rng = np.random.default_rng(seed)
    counts = {k: int((y_all == k).sum()) for k in set(labels) - {default}}
    rules: list[Rule] = []
    for label in sorted(counts, key=lambda k: (counts[k], k)):
        failed, support = 0, max(SUPPORT, int(SUPPORT_SHARE * counts[label]))
        while failed < TRIES:
            idx = np.flatnonzero(live)
            y = y_all[idx] == label
            if not y.any():
                break
            few = y.sum() < FEW
            if few:
                grow = prune = idx
            else:
                draw = np.zeros(len(idx), bool)
                for cls in (True, False):
                    at = rng.permutation(np.flatnonzero(y == cls))
                    draw[at[: len(at) * 2 // 3]] = True
                grow, prune = idx[draw], idx[~draw]
            rule = _grow(x[grow], y_all[grow] == label, names, scale, longest, max(2, support // 2))
            if rule:
                px, py = x[prune], y_all[prune] == label
                while len(rule) > 1:
                    less, more = covers(rule[:-1], names, px), covers(rule, names, px)
                    if (less & ~py).sum() - (more & ~py).sum() > max(1, NOISE * (less & py).sum()):
                        break
                    rule.pop()
                good = _worth(rule, names, px, py)[0] > 0
                worth, p = _worth(rule, names, x[idx], y)
                good = good and worth >= WORTH and p >= support + 2 * (len(rule) - 1) - few
            if not (rule and good) and (few or failed == TRIES - 1):
                rule = _outlier(x[idx], y, names, scale)
                good = bool(rule)
            if not rule or not good:
                failed += TRIES if few else 1
                continue
            failed = 0
            rules.append(Rule(label, tuple(rule)))
            live &= ~covers(rule, names, x)
    return rules


def case_sql(rules: list[Rule], default: str) -> str:
    if not rules:
        return f"'{default}'"
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.label}'" for r in rules) + f" ELSE '{default}' END"


def apply_rules(rules: list[Rule], default: str, names: list[str], x: np.ndarray) -> list[str]:
    out = np.array([default] * len(x), object)
    for r in reversed(rules):
        out[covers(r.conditions, names, x)] = r.label
    return list(out)
