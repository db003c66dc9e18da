"""Camera switching for recordings with several cameras."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Lengths in milliseconds."""

    min_shot: int = 1800
    pre_roll: int = 300
    post_roll: int = 500
    max_shot: int = 14_000
    reaction: int = 2400
    silence_to_wide: int = 3500
    overlap_wide: bool = True
    overlap_min: int = 800
    step: int = 50


@dataclass(frozen=True)
class Camera:
    source: str
    role: str
    speakers: tuple[str, ...] = ()
    offset_ms: int = 0
    duration_ms: int | None = None


def united(turns: list[tuple[str, int, int]], gap_ms: int = 400) -> dict[str, list[list[int]]]:
    """Each speaker's intervals, small gaps closed; speakers in the order of their first word."""
    out: dict[str, list[list[int]]] = {}
    for speaker, start, end in sorted(turns, key=lambda t: t[1]):
        own = out.setdefault(speaker, [])
        if own and start - own[-1][1] <= gap_ms:
            own[-1][1] = max(own[-1][1], end)
        else:
            own.append([start, end])
    return out


class Planner:
    def __init__(self, cameras: list[Camera], rules: Rules = Rules()):
        self.cameras, self.rules = cameras, rules
        self.wide = next((i for i, c in enumerate(cameras) if c.role == "wide"), None)
        self.fallback = self.wide or 0

    def close(self, speaker: str) -> int:
        return next((i for i, c in enumerate(self.cameras) if c.role != "wide" and speaker in c.speakers), self.fallback)

    def wanted(self, intervals: dict[str, list[list[int]]], start: int, end: int) -> list[np.ndarray]:
        """Arrays of cameras, starts and ends: the camera wanted on the grid, in stretches where it stays the same.

        Edges of turns, of their rolls and of the cameras' recordings are put on
        the grid; between two of them nothing changes, so every rule is decided
        once a stretch.  An overlap or a silence that lasts long enough adds the
        place where it does.
        """
        r = self.rules
        n = max(1, round((end - start) / r.step))
        places, speaking, near, ahead = [np.zeros(1, np.int64)], [], [], []

        def on_grid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ab = tuple(np.clip(-((start - np.asarray(x, np.int64)) // r.step), 0, n) for x in (a, b))
            places.extend(ab)
            return ab

        for own in intervals.values():
            s, e = np.array(own, np.int64).T
            rolled = np.concatenate([[np.iinfo(np.int32).min], e[:-1] + r.post_roll + 1])
            speaking.append(on_grid(s, e))
            near.append(on_grid(s - r.pre_roll, e + r.post_roll))
            ahead.append(on_grid(np.maximum(s - r.pre_roll, rolled), s))
        recorded = [on_grid([c.offset_ms], [end + r.step if c.duration_ms is None else c.offset_ms + c.duration_ms + 1]) for c in self.cameras]
        at = np.unique(np.concatenate(places))
        at = at[at < n]

        def holds(spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            """One row per item: in which stretches one of its spans is open."""
            change = np.zeros((len(spans), at.size + 1), np.int64)
            for row, (a, b) in zip(change, spans, strict=True):
                np.add.at(row, np.searchsorted(at, a), 1)
                np.add.at(row, np.searchsorted(at, b), -1)
            return change.cumsum(axis=1)[:, :-1] > 0

        speaks, comes, covered = holds(speaking), holds(ahead), holds(recorded)
        together, quiet = speaks.sum(axis=0) >= 2, ~holds(near).any(axis=0)
        late = []
        for state, wait in ((together, r.overlap_min), (quiet, r.silence_to_wide)):
            since = np.flatnonzero(state & ~np.concatenate([[False], state[:-1]]))
            late.append((at[since], at[since] - -wait // r.step))
        finer = np.unique(np.concatenate([at, *(x[x < n] for _, x in late)]))
        of = np.searchsorted(at, finer, side="right") - 1
        at, together, quiet = finer, together[of], quiet[of]
        lasting = []
        for begun, reached in late:
            i = np.searchsorted(begun, at, side="right") - 1
            lasting.append((i >= 0) & (at >= reached[i]) if begun.size else np.zeros(at.size, bool))

        hold = -1
        want = np.full(at.size, hold)
        if intervals:
            close = np.array([self.close(name) for name in intervals])
            one, soon = speaks.any(axis=0)[of] & ~together, comes.any(axis=0)[of]
            want = np.where(soon, close[comes.argmax(axis=0)[of]], want)
            want = np.where(one, close[speaks.argmax(axis=0)[of]], np.where(together, hold, want))
        if self.wide is not None:
            wide = quiet & lasting[1] | (together & lasting[0] if r.overlap_wide else False)
            want = np.where(wide, self.wide, want)
        if covered.all():
            last = np.maximum.accumulate(np.where(want == hold, -1, np.arange(at.size)))
            cams = np.where(last < 0, self.fallback, want[last])
        else:
            cams = self._recorded(want, covered[:, of], hold)
        new = np.flatnonzero(np.concatenate([[True], cams[1:] != cams[:-1]]))
        begins = start + r.step * at[new]
        return [cams[new], begins, np.append(begins[1:], end)]

    def _recorded(self, want: np.ndarray, covered: np.ndarray, hold: int) -> np.ndarray:
        """Wanted cameras where some don't record: the fallback or the first that does stands in, and is what is held on."""
        stands_in = np.where(covered[self.fallback], self.fallback, np.where(covered.any(axis=0), covered.argmax(axis=0), hold))
        cams, now = want.copy(), self.fallback
        for i, (w, other) in enumerate(zip(want.tolist(), stands_in.tolist(), strict=True)):
            now = now if w == hold else w
            now = now if covered[now, i] or other == hold else other
            cams[i] = now
        return cams

    def long_enough(self, cams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Runs without those shorter than a shot: they belong to the last run before that is none, at the beginning to the first after.

        The first run that ends a shot's length after the beginning takes all
        before it; from there on a run goes on by itself if it is long and its
        camera is not the one of the last long run.
        """
        shot = self.rules.min_shot
        first = min(int(np.searchsorted(ends - starts[0], shot)), cams.size - 1)
        long = np.flatnonzero(ends - starts >= shot)
        long = np.concatenate([[first], long[long > first]])
        kept = long[np.concatenate([[True], cams[long][1:] != cams[long][:-1]])]
        begins = np.concatenate([starts[:1], starts[kept[1:]]])
        return [cams[kept], begins, np.append(begins[1:], ends[-1])]

    def with_cutaways(self, cams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """(camera, start, end, cutaway): reactions at even distances in long close runs, where both sides stay a shot long."""
        out = []
        for cam, a, b in zip(cams.tolist(), starts.tolist(), ends.tolist(), strict=True):
            places = self._reactions(cam, a, b)
            edges = [a, *(int(x) for place in places for x in place), b]
            other = self.reaction_of(cam)
            out += [(other if i % 2 else cam, x, y, bool(i % 2)) for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
        return out

    def reaction_of(self, cam: int) -> int | None:
        """The camera that a long run of ``cam`` is interrupted by."""
        others = [i for i in range(len(self.cameras)) if i != cam]
        return self.wide if self.wide is not None else others[0] if others else None

    def _reactions(self, cam: int, a: int, b: int) -> list[tuple[float, float]]:
        r, other = self.rules, self.reaction_of(cam)
        if self.cameras[cam].role == "wide" or other in (None, cam) or b - a <= r.max_shot:
            return []
        n = int((b - a) // r.max_shot)
        x = a + (b - a) * np.arange(1, n + 1) / (n + 1) - r.reaction / 2
        y = x + r.reaction
        c = self.cameras[other]
        fit = (b - y >= r.min_shot) & (x >= c.offset_ms) & (c.duration_ms is None or y <= c.offset_ms + c.duration_ms)
        x, y = x[fit], y[fit]
        kept, i = [], int(np.searchsorted(x, a + r.min_shot))
        while i < x.size:
            kept.append((np.rint(x[i]), np.rint(y[i])))
            i = int(np.searchsorted(x, kept[-1][1] + r.min_shot))
        return kept

    def plan(self, turns: list[tuple[str, int, int]], start: int, end: int, gap_ms: int = 400) -> list[tuple]:
        return self.with_cutaways(*self.long_enough(*self.wanted(united(turns, gap_ms), start, end)))


def planned_runs(spans: DataFrame, turns: DataFrame, cameras: list[Camera], rules: Rules = Rules()) -> DataFrame:
    """Camera runs of every range (media_id, range_no, start_ms, end_ms): media_id, range_no, run, cam, start_ms, end_ms, cutaway.

    Ranges are independent: each is one row with the turns near it, planned in batches.
    """
    from cutloom.operators import intervals

    margin = rules.silence_to_wide + rules.max_shot
    near = intervals.overlap_join(spans.select("media_id", "range_no", "start_ms", "end_ms"), turns.select("media_id", "speaker", "t_start", "t_end"), ["media_id"], "start_ms", "end_ms", "t_start", "t_end", slack_ms=margin, how="left")
    planner = Planner(cameras, rules)

    turn = F.when(F.col("speaker").isNotNull(), F.struct("t_start", "t_end", "speaker"))
    per = near.groupBy("media_id", "range_no", "start_ms", "end_ms").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                own = [(t["speaker"], int(t["t_start"]), int(t["t_end"])) for t in r.turns]
                runs = planner.plan(own, int(r.start_ms), int(r.end_ms))
                out += [(r.media_id, r.range_no, i, *x) for i, x in enumerate(runs, 1)]
            yield pd.DataFrame(out, columns=["media_id", "range_no", "run", "cam", "start_ms", "end_ms", "cutaway"])

    return per.mapInPandas(run, "media_id bigint, range_no bigint, run bigint, cam int, start_ms bigint, end_ms bigint, cutaway boolean")


def placed_clips(runs: DataFrame, spans: DataFrame, cameras: DataFrame) -> DataFrame:
    """Runs as timeline clips: media_id, range_no, run, source, in_ms, at_ms, dur_ms.

    Camera time is source time less the offset, ranges follow one another;
    what would begin before a camera did is trimmed, and what is left of 20 ms or less goes.
    """
    w = W.partitionBy("media_id").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    at = spans.select("media_id", "range_no", F.col("start_ms").alias("_s"), F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w), F.lit(0)).alias("_c"))
    r = runs.join(at, ["media_id", "range_no"]).join(F.broadcast(cameras), "cam")  # one row per camera
    in_, pos, dur = F.col("start_ms") - F.col("offset_ms"), F.col("_c") + F.col("start_ms") - F.col("_s"), F.col("end_ms") - F.col("start_ms")
    lost = F.greatest(F.lit(0), -in_)
    return r.select("media_id", "range_no", "run", "source", (in_ + lost).alias("in_ms"), (pos + lost).alias("at_ms"), (dur - lost).alias("dur_ms")).filter("dur_ms > 20")


def summary(runs: DataFrame) -> DataFrame:
    """Shots and time of every camera, and of all with the mean and shortest shot: media_id, cam, shots, total_ms, mean_ms, shortest_ms."""
    length = F.col("end_ms") - F.col("start_ms")
    r = runs.rollup("media_id", "cam").agg(F.count("*").alias("shots"), F.sum(length).alias("total_ms"), F.floor(F.avg(length)).alias("mean_ms"), F.min(length).alias("shortest_ms"))
    return r.filter("media_id is not null")


def grid_accuracy(truth: DataFrame, guess: DataFrame, step_ms: int = 100) -> DataFrame:
    """How well labels agree on a time grid: media_id, n, hits.

    Both sides (media_id, start_ms, end_ms, label); points with one true label
    count; each guessed label stands for the true one it meets most.
    """

    def sampled(df: DataFrame, name: str) -> DataFrame:
        first, last = F.ceil(F.col("start_ms") / step_ms), F.ceil(F.col("end_ms") / step_ms) - 1
        grid = df.filter(last >= first).select("media_id", F.explode(F.sequence(first, last)).alias("k"), "label")
        return grid.groupBy("media_id", "k").agg(F.min("label").alias(name), F.count_distinct("label").alias("_n")).filter("_n = 1").drop("_n")

    both = sampled(truth, "t").join(sampled(guess, "g").hint("merge"), ["media_id", "k"], "left")
    met = both.groupBy("media_id", "g", "t").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("media_id", "g").orderBy(F.desc("n"), "t")) == 1
    return met.withColumn("_h", F.when(best & F.col("g").isNotNull(), F.col("n")).otherwise(0)).groupBy("media_id").agg(F.sum("n").alias("n"), F.sum("_h").alias("hits"))


def camera_accuracy(truth: DataFrame, runs: DataFrame, cameras: dict[str, int], step_ms: int = 100, edge_ms: int = 700, wide: int = 0) -> DataFrame:
    """How often the right camera is on: media_id, n, hits.

    Turns (media_id, t_start, t_end, speaker) and runs (media_id, cam, start_ms,
    end_ms, cutaway) meet on a grid.  Points count where somebody speaks, no turn
    begins or ends nearer than ``edge_ms``, and no cutaway is on; several
    speakers at once ask for the wide camera.
    """

    def points(df: DataFrame, a, b, *more: str) -> DataFrame:
        first, last = F.greatest(F.ceil(a / step_ms), F.lit(0)), F.ceil(b / step_ms) - 1
        return df.filter(last >= first).select("media_id", F.explode(F.sequence(first, last)).alias("k"), *more)

    said = points(truth, F.col("t_start"), F.col("t_end"), "speaker").groupBy("media_id", "k").agg(F.count_distinct("speaker").alias("_n"), F.min("speaker").alias("_s"))
    edges = truth.select("media_id", F.explode(F.array("t_start", "t_end")).alias("_x"))
    close = points(edges, F.col("_x") - edge_ms + 1, F.col("_x") + edge_ms).distinct()
    own = F.lit(-1)
    for speaker, cam in cameras.items():
        own = F.when(F.col("_s") == speaker, cam).otherwise(own)
    want = said.join(close.hint("merge"), ["media_id", "k"], "left_anti").select("media_id", "k", F.when(F.col("_n") >= 2, wide).otherwise(own).alias("_want"))
    shown = points(runs, F.col("start_ms"), F.col("end_ms"), "cam", "cutaway")
    seen = want.join(shown.hint("merge"), ["media_id", "k"], "left").filter(~F.coalesce("cutaway", F.lit(False)))
    return seen.groupBy("media_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("cam") == F.col("_want"), F.lit(False)).cast("bigint")).alias("hits"))


def name_tags(tags: DataFrame, shots: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Name tags (media_id, tag_no, person, t_ms) placed where the person is seen long enough: media_id, tag_no, person, t_ms, dur_ms.

    A tag first goes to the person's first wide shot (media_id, person,
    start_ms, end_ms) from a second before it to 90 seconds after it; then to
    the first unbroken run of such shots that begins at most three seconds
    before and leaves two seconds of it.  Without one it stays, and is short.
    The tag of a host (media_id, person) first goes to the recording's first
    wide shot, whoever is in it.
    """
    from cutloom.operators import intervals

    on = ["media_id", "person"]
    near = intervals.neighbours(tags.withColumn("_at", F.col("t_ms") - 1000), shots.select(*on, "start_ms").distinct(), on, "_at", "start_ms")
    moved = F.when(F.col("next_ms") <= F.col("t_ms") + 90_000, F.col("next_ms") + 100).otherwise(F.col("t_ms"))
    if hosts is not None:
        first = shots.groupBy("media_id").agg(F.min("start_ms").alias("_first"))
        near = near.join(hosts.select(*on, F.lit(True).alias("_host")).distinct(), on, "left").join(first, "media_id", "left")
        moved = F.when(F.col("_host"), F.coalesce(F.col("_first") + 200, F.col("t_ms"))).otherwise(moved)
    t = near.select(*on, "tag_no", moved.alias("_ref")).withColumn("_lo", F.col("_ref") - 3000).withColumn("_hi", F.col("_ref") - 501)
    w = W.partitionBy("media_id").orderBy("start_ms", "end_ms")
    change = F.coalesce((F.lag("person").over(w) != F.col("person")) | (F.abs(F.lag("end_ms").over(w) - F.col("start_ms")) >= 80), F.lit(True))
    runs = shots.withColumn("_change", change.cast("int")).withColumn("_run", F.sum("_change").over(w)).groupBy(*on, "_run").agg(F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b")).drop("_run")
    # Runs that begun before the tag must last; of later ones only the length counts, so the next one is enough.
    begun = intervals.overlap_join(t, runs, on, "_lo", "_hi", "_a", "_a").filter(F.col("_b") >= F.col("_ref") + 1620).groupBy("media_id", "tag_no").agg(F.min(F.struct("_a", "_b")).alias("_one"))
    long = runs.filter(F.col("_b") - F.col("_a") >= 2120).groupBy(*on, F.col("_a").alias("next_ms")).agg(F.max("_b").alias("_b2"))
    later = intervals.neighbours(t.withColumn("_from", F.col("_ref") - 500), long, on, "_from", "next_ms").select(*on, "tag_no", "_ref", "next_ms").join(long, [*on, "next_ms"], "left")
    best = F.coalesce(F.col("_one"), F.when(F.col("_b2").isNotNull(), F.struct(F.col("next_ms").alias("_a"), F.col("_b2").alias("_b"))))
    start = F.greatest(F.col("_best._a"), F.col("_ref") - 500) + 120
    placed = later.join(begun, ["media_id", "tag_no"], "left").withColumn("_best", best).withColumn("_st", start)
    seen = F.col("_best").isNotNull()
    return placed.select(
        "media_id", "tag_no", "person", F.when(seen, F.col("_st")).otherwise(F.col("_ref")).alias("t_ms"),
        F.when(seen, F.least(F.lit(3800), F.col("_best._b") - F.col("_st") - 50)).otherwise(2500).cast("bigint").alias("dur_ms"),
    )


def free_tracks(audio: DataFrame) -> DataFrame:
    """Sounds (seq_id, item_no, track) on tracks of their own: seq_id, item_no, track, moved.

    In order, each takes the first track from the one it asks for that none
    before it has; a timeline's few sounds are one array.
    """
    per = audio.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("item_no", F.col("track").cast("bigint").alias("track")))).alias("_a"))

    def taken(used, x):
        free = F.array_except(F.sequence(x["track"], x["track"] + F.size(used)), used)
        return F.concat(used, F.array(F.array_min(free)))

    got = F.aggregate("_a", F.array().cast("array<bigint>"), taken)
    x = F.explode(F.zip_with("_a", got, lambda a, t: F.struct(a["item_no"].alias("item_no"), t.alias("track"), (a["track"] != t).alias("moved"))))
    return per.select("seq_id", x.alias("x")).select("seq_id", "x.*")


def audio_beds(spans: DataFrame, sounds: DataFrame) -> DataFrame:
    """The sound under every range: media_id, range_no, source, track, in_ms, at_ms, dur_ms.

    ``spans`` (media_id, range_no, start_ms, end_ms) follow one another on the
    timeline; ``sounds`` (media_id, source, offset_ms, track) begin so much later
    than the cameras' time.  What would begin before a sound did is trimmed, and
    what is left of 20 ms or less goes.
    """
    w = W.partitionBy("media_id").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    dur = F.col("end_ms") - F.col("start_ms")
    at = spans.select("media_id", "range_no", "start_ms", dur.alias("_d"), F.coalesce(F.sum(dur).over(w), F.lit(0)).alias("_at"))
    r = at.join(sounds, "media_id").withColumn("_in", F.col("start_ms") - F.col("offset_ms"))
    lost = F.greatest(F.lit(0), -F.col("_in"))
    out = r.select("media_id", "range_no", "source", F.coalesce("track", F.lit(0)).alias("track"), (F.col("_in") + lost).alias("in_ms"), (F.col("_at") + lost).alias("at_ms"), (F.col("_d") - lost).alias("dur_ms"))
    return out.filter("dur_ms > 20")
