"""The tree search of :mod:`search` for thousands of problems at a time, their nodes as columns.

All trees of a batch take a step together: selection, scoring and propagation are array operations over the trees that
still grow. It is the search of :class:`search.Search`, with the same trees to the last bit; models that answer for
many paths at a time (a method ``columns``) are searched this way.

A node's place is ``(nid + 1) * trees + tree``. The first row of places is no node: it is the parent of roots and
stands for children that aren't there, so it has no visits and counts as completed.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa

from ..functions.text import REFLECTION_ENDS
from . import search

NONE, ROOT, REASON, FINISH, REFLECT = -1, 0, 1, 2, 3
KINDS = ["Root", "Reason", "Finish", "Reflect"]
#: Texts a worker keeps parsed before it starts anew.
MOST_TEXTS = 200_000


class Columns(Protocol):
    """The model's answers about the problems of a batch. A path is told by its tree, a state of 64 bits that the
    model keeps of its steps, and their number."""

    def root(self) -> np.ndarray:
        """The states of the paths that are a root alone."""

    def follow(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states of the paths with one more step each."""

    def generate(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, action: str, i: np.ndarray) -> np.ndarray:
        """The code of the i-th text of an action, which doesn't depend on how many are asked for."""

    def hits(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of n rollouts reach the answer."""

    def choose(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, i: int) -> np.ndarray:
        """The i-th next action, REASON or FINISH; NONE for none."""

    def value(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The scores of a value model."""


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, fill, width: int | None = None):
        self.fill, self.a = fill, np.full(1024 if width is None else (1024, width), fill, dtype)

    def reach(self, n: int) -> np.ndarray:
        if n > len(self.a):
            more = np.full((max(n, 2 * len(self.a)) - len(self.a), *self.a.shape[1:]), self.fill, self.a.dtype)
            self.a = np.concatenate([self.a, more])
        return self.a


ENDS = re.compile("|".join(map(re.escape, REFLECTION_ENDS)))


class Texts:
    """The distinct texts of a task by number, and what the search reads from each, found once."""

    def __init__(self):
        self.all: list[str] = []
        self.codes: dict[str, int] = {}
        self.told: list[str | None] = []
        self.first, self.crc, self.size = Grown(np.int32, -1), Grown(np.uint32, 0), Grown(np.int64, 0)
        self.rows = {role: Grown(np.int32, -1) for role in ("Reason", "Finish", "Reflect")}
        #: Of an answer's text: how many steps come before the last, whether that says an answer, and all their codes.
        self.before, self.says, self.parts = Grown(np.int32, 0), Grown(bool, False), Grown(np.int32, 0, 1)
        self.n_rows = 0

    def code(self, text: str) -> int:
        found = self.codes.get(text)
        if found is None:
            found = self.codes[text] = len(self.all)
            self.all.append(text)
            said = search.told(text)
            self.told.append(said)
            first = "" if said is None else re.sub("['\"*]", "", said)[:1]
            self.first.reach(found + 1)[found] = -1 if said is None else ord(first) if first else 0
            data = b"\x1f" + text.encode()
            self.crc.reach(found + 1)[found] = zlib.crc32(data)
            self.size.reach(found + 1)[found] = len(data)
        return found

    def read(self, role: str, codes: np.ndarray) -> np.ndarray:
        """The rows of what texts of an action are read as."""
        rows = self.rows[role]
        out = rows.reach(len(self.all))[codes]
        for c in set(codes[out < 0].tolist()):
            rows.a[c] = self._read(role, self.all[c])
            rows.reach(len(self.all))
        return rows.a[codes]

    def _read(self, role: str, text: str) -> int:
        if role == "Reflect":
            text = "But wait, " + ENDS.split(text, maxsplit=1)[0]
        text = text.strip().removeprefix("<steps>").strip()
        if role == "Reason":
            steps, says = [text], search.told(text) is not None
        else:
            *before, last = search.answer_steps(text)
            steps, says = [*before, search.single_answer(last)], bool(search.told(last))
        row = self.n_rows
        self.n_rows += 1
        if len(steps) > self.parts.a.shape[1]:
            wider = Grown(np.int32, 0, len(steps))
            wider.reach(len(self.parts.a))[:, : self.parts.a.shape[1]] = self.parts.a
            self.parts = wider
        self.before.reach(row + 1)[row] = len(steps) - 1
        self.says.reach(row + 1)[row] = says
        self.parts.reach(row + 1)[row, : len(steps)] = [self.code(s) for s in steps]
        return row


class Logs:
    """Logarithms of whole numbers as the math module gives them."""

    def __init__(self):
        self.a = np.array([0.0, *(math.log(i) for i in range(1, 1024))])

    def __call__(self, n: np.ndarray) -> np.ndarray:
        if len(n) and (most := int(n.max())) >= len(self.a):
            self.a = np.concatenate([self.a, [math.log(i) for i in range(len(self.a), 2 * most)]])
        return self.a[n]


class Kept:
    """What the tasks of a worker share: the texts read so far, and logarithms."""

    texts, logs = Texts(), Logs()

    @classmethod
    def known(cls) -> tuple[Texts, Logs]:
        if len(cls.texts.all) > MOST_TEXTS:
            cls.texts = Texts()
        return cls.texts, cls.logs


class Forest:
    """The searches of a batch of problems, whose lengths are within the limit."""

    def __init__(self, problems: list[str], answers: list[str], model: Columns, texts: Texts, config: search.Config, logs: Logs):
        self.answers, self.model, self.texts, self.config, self.log = answers, model, texts, config, logs
        self.n = n = len(problems)
        #: The one letter of an answer; 0 of a longer one.
        self.letter = np.array([ord(a) if len(a) == 1 else 0 for a in answers], np.int32)
        self.count, self.deepest = np.ones(n, np.int64), np.zeros(n, np.int64)
        self.budget, self.right = np.full(n, config.max_nodes, np.int64), np.zeros(n, np.int64)
        self.rows = 1
        empty = {
            "parent": (np.int64, 0), "kind": (np.int8, NONE), "text": (np.int32, -1), "value": (np.float64, 0.0), "visits": (np.int32, 0), "sim": (np.float64, np.nan),
            "correct": (bool, False), "completed": (bool, False), "refined": (np.int16, 0), "depth": (np.int32, 0), "children": (np.int16, 0), "own": (bool, False),
            "drawn": (np.float64, np.nan), "product": (np.float64, 1.0), "state": (np.int64, 0),
            # Which child of its parent a node is, how often its children were visited, how many of them aren't completed.
            "place": (np.int8, 0), "below": (np.int32, 0), "undone": (np.int16, 0),
        }
        self.empty = empty
        for name, (dtype, fill) in empty.items():
            setattr(self, name, np.full(n, fill, dtype))
        self.child = [np.zeros(n, np.int64) for _ in range(config.max_children)]
        #: Value times visits of each child.
        self.weighted = np.zeros((n, config.max_children))
        self.completed[:] = True
        self.make_rows(max(2, config.max_nodes + 1))
        root = np.arange(n, 2 * n)
        self.parent[root], self.kind[root], self.text[root] = np.arange(n), ROOT, texts.code(search.ROOT_TEXT)
        self.parent[:n] = np.arange(n)
        self.state[root] = model.root()

    def make_rows(self, rows: int) -> None:
        if rows <= self.rows:
            return
        more = (max(rows, self.rows * 3 // 2) - self.rows) * self.n
        for name, (dtype, fill) in self.empty.items():
            setattr(self, name, np.concatenate([getattr(self, name), np.full(more, fill, dtype)]))
        # A missing child is any place of the first row.
        self.child = [np.concatenate([c, np.zeros(more, np.int64)]) for c in self.child]
        self.weighted = np.concatenate([self.weighted, np.zeros((more, len(self.child)))])
        self.rows += more // self.n

    def matrix(self, name: str, trees: np.ndarray) -> np.ndarray:
        """A column's values by nid and tree."""
        top = int(self.count[trees].max()) + 1 if len(trees) else 1
        return getattr(self, name).reshape(self.rows, self.n)[1:top][:, trees]

    def add(self, at: np.ndarray, kind: np.ndarray | int, text: np.ndarray, refined: np.ndarray | int = 0) -> np.ndarray:
        trees = at % self.n
        count = self.count[trees] + 1
        if len(count):
            self.make_rows(int(count.max()) + 1)
        new = count * self.n + trees
        depth = self.depth[at] + 1
        self.parent[new], self.kind[new], self.text[new], self.refined[new], self.depth[new] = at, kind, text, refined, depth
        self.state[new] = self.model.follow(self.state[at], text)
        place = self.children[at]
        for k, c in enumerate(self.child):
            here = place == k
            c[at[here]] = new[here]
        self.place[new], self.children[at] = place, place + 1
        self.undone[at] += 1
        self.count[trees] = count
        self.deepest[trees] = np.maximum(self.deepest[trees], depth)
        return new

    # Selection ---------------------------------------------------------------------------

    def can_refine(self, at: np.ndarray) -> np.ndarray:
        c = self.config
        return (self.kind[at] == FINISH) & (self.value[at] < c.low_gate) & (self.refined[at] < c.refine_limit)

    def priority(self, child: np.ndarray, log: np.ndarray) -> np.ndarray:
        c = self.config
        visits = self.visits[child]
        value = (self.value if c.training else self.product)[child]
        out = value + c.constant * np.sqrt(log / np.maximum(visits, 1))
        finish, done = self.kind[child] == FINISH, self.completed[child]
        maybe = np.flatnonzero(done | finish)
        some = child[maybe]
        shut = (finish[maybe] & self.correct[some]) | (done[maybe] & ~self.can_refine(some))
        out[maybe[shut]] = -1.0
        out[visits == 0] = c.unvisited_ucb
        out[child < self.n] = -np.inf
        return out

    def pick(self, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that selection leads to, and whether there is one."""
        at, found = trees + self.n, np.ones(len(trees), bool)
        going = np.flatnonzero(self.children[at] > 0)
        while len(going):
            here = at[going]
            log = self.log(self.visits[here])
            to = self.child[0][here]
            best = self.priority(to, log)
            for c in self.child[1:]:
                child = c[here]
                other = self.priority(child, log)
                more = other > best
                best, to = np.where(more, other, best), np.where(more, child, to)
            shut = best <= -1
            found[going[shut]] = False
            at[going] = to
            going = going[~shut]
            going = going[self.children[at[going]] > 0]
        return at, found

    # Expansion ---------------------------------------------------------------------------

    def step(self, trees: np.ndarray) -> np.ndarray:
        """One round; the trees that have changed."""
        c = self.config
        at, found = self.pick(trees)
        low = self.value[at] < c.low_gate
        found &= ~((self.kind[at] == FINISH) & (self.value[at] > 0)) & ((self.visits[at] == 0) == (at < 2 * self.n))
        found &= ~(self.completed[at] & low & (self.refined[at] < c.refine_limit))
        trees, at = trees[found], at[found]
        k = c.max_children
        names = np.full((k if k > 0 else 1, len(at)), NONE)
        sim = self.sim[at]
        sure = sim >= c.bear_ratio
        root = ~sure & (at < 2 * self.n)
        refine = ~sure & ~root & self.can_refine(at)
        asked = np.flatnonzero(~sure & ~root & ~refine)
        names[0, sure], names[:, root], names[0, refine] = FINISH, REASON, REFLECT
        again = at[refine]
        self.undone[self.parent[again]] += self.completed[again]
        self.kind[again], self.completed[again] = REASON, False
        some = at[asked]
        for i in range(k):
            names[i, asked] = self.model.choose(trees[asked], self.state[some], self.depth[some] + 1, i)
        none = asked[(names[:, asked] == NONE).all(axis=0)]
        names[:, none] = REASON
        # Places without a name are left out.
        state, steps = self.state[at], self.depth[at] + 1
        raw = np.zeros(names.shape, np.int64)
        for name in (REASON, FINISH, REFLECT):
            here = names == name
            turn = np.cumsum(here, axis=0) - 1
            i, tree = np.nonzero(here)
            if len(i):
                raw[i, tree] = self.model.generate(trees[tree], state[tree], steps[tree], KINDS[name], turn[i, tree])
        for i in range(len(names)):
            reason = np.flatnonzero(names[i] == REASON)
            if len(reason):
                rows = self.texts.read("Reason", raw[i, reason])
                kinds = np.where(self.texts.says.a[rows], FINISH, REASON)
                self.score(self.add(at[reason], kinds, self.texts.parts.a[rows, 0]))
            for name in (FINISH, REFLECT):
                here = np.flatnonzero(names[i] == name)
                if len(here):
                    self.answer_nodes(at[here], raw[i, here], KINDS[name])
        return trees

    def answer_nodes(self, at: np.ndarray, raw: np.ndarray, role: str) -> None:
        rows = self.texts.read(role, raw)
        reflected = role == "Reflect"
        before, parts = self.texts.before.a[rows], self.texts.parts.a[rows]
        refined = self.refined[at] + int(reflected)
        at = at.copy()
        for b in range(int(before.max())):
            more = np.flatnonzero(before > b)
            over = at[more]
            new = self.add(over, REFLECT if reflected else REASON, parts[more, b], refined[more])
            self.value[new], self.visits[new], self.product[new] = self.value[over], 1, self.product[over]
            self.weighted[over, self.place[new]] = self.value[over]
            self.below[over] += 1
            at[more] = new
        self.budget[at % self.n] += before
        self.score(self.add(at, np.where(self.texts.says.a[rows], FINISH, REASON), parts[np.arange(len(at)), before], refined))

    # Scoring -----------------------------------------------------------------------------

    def verdict(self, at: np.ndarray) -> np.ndarray:
        text, letter = self.text[at], self.letter[at % self.n]
        out = (self.texts.first.a[text] == letter).astype(float)
        for i in np.flatnonzero(letter == 0).tolist():
            said, answer = self.texts.told[text[i]], self.answers[at[i] % self.n]
            if said is None:
                out[i] = 0.0
            elif len(answer) == 1:
                out[i] = answer in re.sub("['\"*]", "", said)[:1]
            else:
                out[i] = answer.lower() in said.lower()
        return out

    def score(self, at: np.ndarray) -> None:
        c = self.config
        finish = self.kind[at] == FINISH
        value, sim = np.zeros(len(at)), np.full(len(at), np.nan)
        if c.value_model:
            value = self.model.value(at % self.n, self.state[at], self.depth[at] + 1)
            if c.training:
                sim[finish] = self.verdict(at[finish])
        else:
            value[finish] = self.verdict(at[finish])
            other = at[~finish]
            if len(other):
                n = np.maximum(c.simulation // (self.depth[other] + 1), 5)
                value[~finish] = self.model.hits(other % self.n, self.state[other], self.depth[other] + 1, n) / n
            sim = value
        if "Reflect" in c.actions:
            self.kind[at[finish & (value < c.low_gate)]] = REASON
        self.propagate(at, value, sim)

    def propagate(self, at: np.ndarray, value: np.ndarray, sim: np.ndarray) -> None:
        c = self.config
        self.sim[at], self.drawn[at], self.own[at] = sim, value, True
        finish, scored = self.kind[at] == FINISH, ~np.isnan(sim)
        up = self.parent[at]
        self.product[at] = self.product[up] * value
        value = np.where(finish & scored, sim, value)
        self.value[at] = value
        completed = finish & ((value >= c.bear_ratio) | ((value < c.low_gate) & (self.refined[at] >= c.refine_limit)))
        correct = scored & (sim >= c.bear_ratio)
        self.correct[at] = correct
        self.right[at % self.n] += correct
        while True:
            # A node goes from ``was`` to ``completed``, and its parent learns of it.
            visits = self.visits[at] + 1
            was = self.completed[at]
            self.visits[at], self.completed[at] = visits, completed
            more = np.flatnonzero(up >= self.n)
            if len(more) < len(up):
                at, up, value, visits, was, completed = at[more], up[more], value[more], visits[more], was[more], completed[more]
            if not len(up):
                break
            self.weighted[up, self.place[at]] = value * visits
            below, undone = self.below[up] + 1, self.undone[up] + was - completed
            self.below[up], self.undone[up] = below, undone
            each = self.weighted[up]
            total = each[:, 0]
            for k in range(1, each.shape[1]):
                total = total + each[:, k]
            value = total / below
            if c.update_rule == "comp":
                value = (self.value[up] + value) / 2
            self.value[up], completed = value, undone == 0
            at, up = up, self.parent[up]

    # The loop ----------------------------------------------------------------------------

    def leaves(self, trees: np.ndarray) -> np.ndarray:
        return (self.matrix("kind", trees) != NONE) & (self.matrix("children", trees) == 0)

    def done(self, trees: np.ndarray) -> np.ndarray:
        c = self.config
        out = self.deepest[trees] >= c.max_depth if c.rule == "depth" else self.count[trees] >= self.budget[trees]
        shut = np.flatnonzero(~out & self.completed[trees + self.n])
        some = trees[shut]
        out[shut] = ~(self.leaves(some) & ~((self.matrix("kind", some) == FINISH) & self.matrix("completed", some))).any(axis=0)
        if c.correct_nodes is not None:
            many = np.flatnonzero(~out & (self.right[trees] >= c.correct_nodes))
            out[many] = self.distinct_right(trees[many]) >= c.correct_nodes
        return out

    def distinct_right(self, trees: np.ndarray) -> np.ndarray:
        """How many right leaves a tree has; those of equal texts up to the root are one."""
        right = self.matrix("correct", trees) & self.leaves(trees)
        tree, nid = np.nonzero(right.T)
        if not len(tree):
            return np.zeros(len(trees), np.int64)
        place = np.arange(len(tree)) - np.searchsorted(tree, tree)
        at = np.zeros((len(trees), int(place.max()) + 1), np.int64)
        at[tree, place] = (nid + 1) * self.n + trees[tree]
        there, path = at > 0, []
        while (at >= self.n).any():
            path.append(self.text[at])
            at = self.parent[at]
        path = np.stack(path, axis=2)
        new = there.copy()
        for i in range(1, path.shape[1]):
            for j in range(i):
                new[:, i] &= ~(there[:, j] & (path[:, i] == path[:, j]).all(axis=1))
        return new.sum(axis=1)

    def grow(self) -> Forest:
        trees = np.arange(self.n)
        while len(trees):
            trees = trees[~self.done(trees)]
            if len(trees):
                trees = self.step(trees)
        self.close()
        return self

    def close(self) -> None:
        c = self.config
        trees = np.arange(self.n)
        right = (self.leaves(trees) & (self.matrix("kind", trees) == FINISH) & (self.matrix("correct", trees) | (not c.training))).sum(axis=0)
        trees = trees[~(self.completed[trees + self.n] | ((right > search.ENOUGH) & (not c.finish_uncompleted)))]
        if not len(trees):
            return
        nid, tree = np.nonzero(self.leaves(trees) & (self.matrix("kind", trees) != FINISH))
        if not len(nid):
            return
        at = (nid + 1) * self.n + trees[tree]
        order = np.lexsort((self.walk_order(trees)[nid, tree], -self.value[at], tree))
        at, tree = at[order], tree[order]
        rank = np.arange(len(at)) - np.searchsorted(tree, tree)
        by_rank = np.argsort(rank, kind="stable")
        raw = self.model.generate(at % self.n, self.state[at], self.depth[at] + 1, "Finish", np.zeros(len(at), np.int64))
        for some in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]):
            if len(some):
                self.answer_nodes(at[some], raw[some], "Finish")

    def walk_order(self, trees: np.ndarray) -> np.ndarray:
        """By nid and tree: the nodes that a walk meets before."""
        size = (self.kind != NONE).astype(np.int32)
        size[: self.n] = 0
        before = np.zeros(len(size), np.int32)
        top = int(self.count[trees].max())
        for nid in range(top - 1, 0, -1):
            at = (nid + 1) * self.n + trees[self.count[trees] > nid]
            size[self.parent[at]] += size[at]
        size[: self.n] = 0
        for nid in range(top):
            at = (nid + 1) * self.n + trees[self.count[trees] > nid]
            at = at[self.children[at] > 0]
            next_ = before[at] + 1
            for child in self.child:
                k = child[at]
                before[k] = next_
                next_ = next_ + size[k]
        return before.reshape(self.rows, self.n)[1 : top + 1][:, trees]

    # Results -----------------------------------------------------------------------------

    def with_right(self) -> np.ndarray:
        return self.right > 0

    def records(self, ids: list[str], trees: np.ndarray, columns: list[str]) -> pa.RecordBatch:
        """The nodes of some trees, in the columns of :data:`search.SCHEMA` that are asked for."""
        there = self.matrix("kind", trees) != NONE
        tree, nid = np.nonzero(there.T)
        at = (nid + 1) * self.n + trees[tree]
        up = self.parent[at]
        make = {
            "id": lambda: pa.array(ids, pa.string()).take(pa.array(trees[tree])),
            "nid": lambda: nid,
            "pid": lambda: pa.array(up // self.n - 1, pa.int64(), mask=up < self.n),
            "depth": lambda: self.depth[at],
            "type": lambda: pa.array(KINDS).take(pa.array(self.kind[at])),
            "step": lambda: pa.array(self.texts.all, pa.string()).take(pa.array(self.text[at])),
            "v": lambda: self.value[at],
            "n": lambda: self.visits[at],
            "sim": lambda: pa.array(self.sim[at], mask=np.isnan(self.sim[at])),
            "correct": lambda: self.correct[at],
            "completed": lambda: self.completed[at],
            "refine_cnt": lambda: self.refined[at],
            "value_trajectory": lambda: self.trajectories(at),
        }
        return pa.RecordBatch.from_arrays([pa.array(a).cast(search.TYPES[c]) if c != "value_trajectory" else a for c in columns for a in [make[c]()]], columns)

    def trajectories(self, at: np.ndarray) -> pa.Array:
        """The values that were drawn along each path."""
        sizes, over = np.zeros(len(at), np.int64), at
        while (over >= self.n).any():
            sizes += self.own[over]
            over = self.parent[over]
        ends = np.cumsum(sizes)
        values, to = np.zeros(int(ends[-1]) if len(ends) else 0), ends - 1
        while (at >= self.n).any():
            own = self.own[at]
            values[to[own]] = self.drawn[at[own]]
            to = to - own
            at = self.parent[at]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


# Models --------------------------------------------------------------------------------------


class Crc:
    """CRC-32 of texts put together from those of their parts: a checksum moves over n bytes by a linear map."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        self.step = step
        self.tables = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])[None]

    def join(self, a: np.ndarray, b: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
        """Checksums of texts a + b from those of a and b, with the bytes of b."""
        size = np.asarray(size)
        most = int(size.max()) if size.size else 0
        while len(self.tables) <= most:
            last = self.tables[-1]
            more = []
            for _ in range(max(64, len(self.tables))):
                last = (last >> np.uint32(8)) ^ self.step[last & np.uint32(255)]
                more.append(last)
            self.tables = np.concatenate([self.tables, np.stack(more)])
        flat, base = self.tables.reshape(-1), size * 1024
        a = a.astype(np.int64)
        out = flat[base + (a & 255)] ^ flat[base + 256 + (a >> 8 & 255)] ^ flat[base + 512 + (a >> 16 & 255)] ^ flat[base + 768 + (a >> 24)]
        return out ^ np.asarray(b, dtype=np.uint32)

    def behind(self, a: np.ndarray, text: str) -> np.ndarray:
        data = text.encode()
        return self.join(a, zlib.crc32(data), len(data))


CRC = Crc()
LOW = (1 << 32) - 1


class HashColumns:
    """The answers of :class:`search.HashModel`. The state of a path is its steps' checksum and their bytes."""

    def __init__(self, skill: int, problems: list[str], texts: Texts):
        self.skill, self.texts = skill, texts
        self.start = np.array([zlib.crc32(p.encode()) for p in problems], np.uint32)

    def root(self) -> np.ndarray:
        return self.follow(np.zeros(len(self.start), np.int64), np.full(len(self.start), self.texts.code(search.ROOT_TEXT)))

    def follow(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        size = self.texts.size.a[codes]
        crc = CRC.join(state & LOW, self.texts.crc.a[codes], size)
        return ((state >> 32) + size << 32) | crc

    def draw(self, head: np.ndarray, state: np.ndarray, *parts: str) -> np.ndarray:
        out = CRC.join(head, state & LOW, state >> 32)
        return CRC.behind(out, "".join("\x1f" + p for p in parts))

    def generate(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, action: str, i: np.ndarray) -> np.ndarray:
        head = self.start[trees]
        for s in np.flatnonzero(np.bincount(steps)).tolist():
            here = steps == s
            head[here] = CRC.behind(head[here], f"\x1f{s}")
        drawn = self.draw(head, state, action)
        for k in np.flatnonzero(np.bincount(i)).tolist():
            here = i == k
            drawn[here] = CRC.behind(drawn[here], f"\x1f{k}")
        drawn = drawn.astype(np.int64)
        what = drawn % 997
        if action in ("Finish", "Reflect"):
            what = ((steps * 997 + what) * 2 + (drawn // 4 % 2)) * 4 + drawn % 4
        return self.known(action in ("Finish", "Reflect"), what)

    def known(self, answer: bool, what: np.ndarray) -> np.ndarray:
        table = self.texts.__dict__.setdefault(f"hash_{answer}", Grown(np.int64, -1))
        out = table.reach(int(what.max()) + 1)[what]
        for w in set(what[out < 0].tolist()):
            text = f"Consider {w}."
            if answer:
                rest, letter = divmod(w, 4)
                rest, more = divmod(rest, 2)
                steps, number = divmod(rest, 997)
                text = f"Consider {number}." + (f"\n\nStep {steps + 1}: Sum up." if more else "") + f" The answer is {'ABCD'[letter]}."
            table.a[w] = self.texts.code(text)
        return table.a[what]

    def hits(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, n: np.ndarray) -> np.ndarray:
        first = self.draw(self.start[trees], state, "rollout")
        out, behind = np.zeros(len(first), np.int64), {}
        for i in range(int(n.max()) if len(n) else 0):
            digits = b"%d" % i
            if len(digits) not in behind:
                behind[len(digits)] = CRC.join(first, 0, len(digits))
            out += ((behind[len(digits)] ^ np.uint32(zlib.crc32(digits))) % np.uint32(100) < self.skill) & (i < n)
        return out

    def choose(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, i: int) -> np.ndarray:
        drawn = CRC.behind(self.draw(self.start[trees], state, "choose"), str(i))
        return np.where(drawn % np.uint32(2) == 0, REASON, FINISH)

    def value(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return self.draw(self.start[trees], state, "value") % np.uint32(101) / 100


class ScriptColumns:
    """The answers of :class:`search.ScriptModel`; its paths have no state."""

    def __init__(self, problems: list[str], texts: Texts):
        self.texts, self.groups, self.made = texts, {}, {}
        kinds = [p.rpartition(" ")[2] for p in problems]
        rank = {"sure": 0, "lost": 1, "slow": 2, "long": 3}
        self.kind = np.array([rank.get(k, 4) for k in kinds], np.int64)
        said = ((k == "long", "none" if k == "lost" else p.partition(" ")[0]) for p, k in zip(problems, kinds, strict=True))
        self.group = np.array([self.groups.setdefault(s, len(self.groups)) for s in said], np.int64)

    def root(self) -> np.ndarray:
        return np.zeros(len(self.kind), np.int64)

    def follow(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return state

    def generate(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, action: str, i: np.ndarray) -> np.ndarray:
        n = int(i.max()) + 1
        if action == "Reason":
            return np.array([self.texts.code(f"Look {k}.") for k in range(n)])[i]
        if n not in self.made:
            leads = {True: "Look back {i}.\n\nStep 1: Sum up.", False: "Sum up {i}."}
            self.made[n] = np.array([[self.texts.code(f"{leads[long].format(i=k)} The answer is {said}.") for k in range(n)] for long, said in self.groups])
        return self.made[n][self.group[trees], i]

    def hits(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, n: np.ndarray) -> np.ndarray:
        kind = self.kind[trees]
        return np.where(kind == 0, n, np.where(kind == 1, 0, (n + 1) // 2))

    def choose(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray, i: int) -> np.ndarray:
        return np.where(self.kind[trees] == 2, NONE, FINISH)

    def value(self, trees: np.ndarray, state: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.array([1.0, 0.0, 0.5, 0.5, 0.5])[self.kind[trees]]
