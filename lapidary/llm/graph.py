"""A navigable small-world graph over unit vectors in numpy, built and searched for many queries at once."""

from __future__ import annotations

import numpy as np

FORWARD, REVERSE, EXTRA, ENTRIES = 12, 26, 6, 24
WIDTH = FORWARD + REVERSE + EXTRA
BUILD_BEAM, BATCH = 32, 2048
#: Queries that walk side by side; the nodes of four steps at most have numbers below 256.
CHUNK = 1024
#: A beam is wide enough when it finds this share of the nodes that an exhaustive search finds for sample queries.
TARGET_RECALL, SAMPLE = 0.99, 800


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if ids.shape[1] <= k:
        return ids, sims
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


class Graph:
    """Nodes link to the nearest that were inserted before them (forward), to near later ones (reverse), and to later ones
    that nothing else leads to (extra)."""

    def __init__(self, vectors: np.ndarray, links: np.ndarray | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        if links is None:
            self.links = np.full((n, WIDTH), -1, np.int32)
            self._build()
            self._connect()
        else:
            self.links = links.reshape(n, WIDTH)

    def _entries(self, n: int) -> np.ndarray:
        return np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int32))

    def _build(self) -> None:
        n, v = len(self.vectors), self.vectors
        done = 0
        reverse_sims = np.full((n, REVERSE), -4, np.float32)
        while done < n:
            stop = min(n, done + (512 if done < 2048 else min(BATCH, done // 4)))
            own = v[done:stop]
            # Exact neighbours among those inserted together, only towards earlier ones.
            sims = own @ own.T
            sims[np.triu_indices(len(own))] = -2
            k = min(FORWARD, len(own))
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int32)
            near, near_sims = at + done, np.take_along_axis(sims, at, 1)
            if done:
                ids, found = self.search(own, BUILD_BEAM, done)
                near, near_sims = np.hstack([ids, near]), np.hstack([found, near_sims])
            near, near_sims = _top(near, near_sims, FORWARD)
            near = np.where(near_sims > -2, near, -1)
            self.links[done:stop, : near.shape[1]] = near
            # Reverse links: the best of the old and the new ones stay.
            source = np.repeat(np.arange(done, stop, dtype=np.int32), near.shape[1])
            # The link from a node's nearest neighbour comes before all that are merely close, so that every node can be reached.
            nearest = near_sims >= near_sims.max(axis=1, keepdims=True)
            target, sim = near.ravel(), (near_sims + 2 * nearest).ravel()
            real = target >= 0
            source, target, sim = source[real], target[real], sim[real]
            touched = np.unique(target)
            old = self.links[touched, FORWARD : FORWARD + REVERSE]
            held = old >= 0
            target = np.concatenate([np.repeat(touched, REVERSE)[held.ravel()], target])
            source = np.concatenate([old[held], source])
            sim = np.concatenate([reverse_sims[touched][held], sim])
            order = np.lexsort((-sim, target))
            target, source, sim = target[order], source[order], sim[order]
            first = np.r_[True, target[1:] != target[:-1]]
            place = np.arange(len(target)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            keep = place < REVERSE
            self.links[touched, FORWARD : FORWARD + REVERSE] = -1
            self.links[target[keep], FORWARD + place[keep]] = source[keep]
            reverse_sims[target[keep], place[keep]] = sim[keep]
            done = stop

    def _reached(self) -> np.ndarray:
        """Which nodes a walk from the entries can reach."""
        reached = np.zeros(len(self.vectors), bool)
        edge = self._entries(len(self.vectors))
        while len(edge):
            reached[edge] = True
            edge = np.unique(self.links[edge])
            edge = edge[edge >= 0]
            edge = edge[~reached[edge]]
        return reached

    def _connect(self) -> None:
        """Give nodes that can't be reached an extra link from one of their forward neighbours."""
        for _ in range(20):
            reached = self._reached()
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            for k in range(FORWARD):
                at = self.links[lost, k]
                ok = (at >= 0) & reached[np.maximum(at, 0)]
                target, source = at[ok], lost[ok]
                order = np.argsort(target, kind="stable")
                target, source = target[order], source[order]
                used = (self.links[target, FORWARD + REVERSE :] >= 0).sum(axis=1)
                first = np.r_[True, target[1:] != target[:-1]][: len(target)]
                place = used + np.arange(len(target)) - (np.flatnonzero(first)[np.cumsum(first) - 1] if len(target) else 0)
                fits = place < EXTRA
                self.links[target[fits], FORWARD + REVERSE + place[fits]] = source[fits]
                lost = np.setdiff1d(lost, source[fits])

    def search(self, queries: np.ndarray, beam: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beam of every query, -1 where the beam isn't full; ``among`` the first nodes."""
        n = len(self.vectors) if among is None else among
        beam = min(beam, n)
        out_ids = np.full((len(queries), beam), -1, np.int32)
        out_sims = np.full((len(queries), beam), -2, np.float32)
        step = int(max(16, min(CHUNK, 60_000_000 // max(1, n))))
        for a in range(0, len(queries), step):
            ids, sims = self._beam(np.ascontiguousarray(queries[a : a + step], np.float32), beam, n)
            out_ids[a : a + step], out_sims[a : a + step] = ids, sims
        return out_ids, out_sims

    def _beam(self, q: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        v, links = self.vectors, self.links
        m, width = len(q), max(1, min(4, beam // 8))
        entries = self._entries(n)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        seen[:, entries] = True
        marks, last = seen.reshape(-1), np.empty(m * (n + 1), np.uint8)
        ids = np.tile(entries, (m, 1))
        sims = q @ v[entries].T
        ids, sims = _top(ids, sims, beam)
        opened = np.zeros(ids.shape, bool)
        active = np.arange(m)
        full_ids = np.full((m, beam), -1, np.int32)
        full_sims = np.full((m, beam), -2, np.float32)
        while len(active):
            # The best nodes of each beam that weren't expanded yet.
            open_sims = np.where(opened, -3, sims)
            w = min(width, ids.shape[1])
            pick = np.argpartition(-open_sims, w - 1, axis=1)[:, :w] if w < ids.shape[1] else np.tile(np.arange(w), (len(active), 1))
            fresh = np.take_along_axis(open_sims, pick, 1) > -2
            alive = fresh.any(axis=1)
            if not alive.all():
                gone = ~alive
                full_ids[active[gone], : ids.shape[1]] = ids[gone]
                full_sims[active[gone], : ids.shape[1]] = sims[gone]
                active, ids, sims, opened, pick, fresh = active[alive], ids[alive], sims[alive], opened[alive], pick[alive], fresh[alive]
                if not len(active):
                    break
            np.put_along_axis(opened, pick, True, 1)
            chosen = np.where(fresh, np.take_along_axis(ids, pick, 1), -1)
            near = np.take(links, chosen, axis=0, mode="wrap").reshape(len(active), -1)
            near = np.where(np.repeat(chosen < 0, links.shape[1], axis=1) | (near < 0) | (near >= n), n, near)
            flat = near + active[:, None] * (n + 1)
            new = ~np.take(marks, flat)
            marks[flat] = True
            # One of two equal nodes within a row is enough: the one whose number stays when all write to their place.
            numbers = np.broadcast_to(np.arange(near.shape[1], dtype=np.uint8), near.shape)
            last[flat] = numbers
            new &= last[flat] == numbers
            near_sims = np.full(near.shape, -2, np.float32)
            rows, columns = np.nonzero(new)
            near_sims[rows, columns] = np.einsum("ij,ij->i", v[near[rows, columns]], q[active[rows]])
            ids, sims2 = np.hstack([ids, near]), np.hstack([sims, near_sims])
            opened = np.hstack([opened, near_sims <= -2])
            k = min(beam, ids.shape[1])
            at = np.argpartition(-sims2, k - 1, axis=1)[:, :k] if k < ids.shape[1] else np.tile(np.arange(k), (len(ids), 1))
            ids, sims, opened = (np.take_along_axis(x, at, 1) for x in (ids, sims2, opened))
        return np.where(full_sims > -2, full_ids, -1), full_sims

    def tuned_beam(self, queries: np.ndarray, true: list[np.ndarray], start: int = 48, widest: int = 1024) -> int | None:
        """The narrowest beam, widened by halves from ``start``, that finds TARGET_RECALL of the nodes ``true`` that an
        exhaustive search found for the sample ``queries``; None if even the widest one doesn't."""
        n = len(self.vectors)
        beam = start
        while beam < n:
            # A query with more true nodes than half a beam can't be judged by it; such queries are told by their crowded beams.
            told = [i for i, t in enumerate(true) if 0 < len(t) <= beam // 2]
            total = sum(len(true[i]) for i in told)
            if not total:
                break
            ids, _ = self.search(queries[told], beam)
            hit = sum(np.isin(true[i], found).sum() for i, found in zip(told, ids))
            if hit >= TARGET_RECALL * total:
                break
            beam += beam // 2
            if beam > widest:
                return None
        return max(1, min(beam, n))
