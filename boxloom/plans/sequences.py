"""Image sequences: tracks, samples, frames and summaries of the files of a container.

All is worked out in the row of a file by expressions (functions/tracks.py) and exploded from there: no joins, windows or exchanges, and
nothing is kept. All rows carry (file_id, track). A track that breaks a rule has an error, and no frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import tracks as tr
from boxloom.functions.arrays import let
from boxloom.functions.tracks import rescale
from boxloom.sources.movies import with_roles
from boxloom.sources.tables import Container

__all__ = ["Sequences", "lookup", "rescale"]


class Sequences:
    """The sequences of some files; each table is a lazy DataFrame."""

    def __init__(self, c: Container):
        self.c = c

    @cached_property
    def rows(self) -> DataFrame:
        """A row for each file with tracks: told, roles, matches, usable."""
        return with_roles(self.c.raw.where(F.size("tracks") > 0), self.c.limits)

    @cached_property
    def tracks(self) -> DataFrame:
        return self.c.tracks

    def _each(self, *columns: str) -> DataFrame:
        return self.rows.select("file_id", "movie_timescale", "roles", F.explode("told").alias("t")).select("file_id", "movie_timescale", "roles", F.col("t.track").alias("track"), *[F.col(f"t.{c}").alias(c) for c in columns])

    @cached_property
    def roles(self) -> DataFrame:
        """(file_id, track, role): the image track, and its alpha and thumbnail tracks."""
        named = F.array(*[F.struct(F.col(f"roles.{r}").alias("track"), F.lit(r).alias("role")) for r in ("image", "alpha", "thumbnail")])
        return self.rows.select("file_id", F.explode(F.filter(named, lambda r: r["track"].isNotNull())).alias("r")).select("file_id", "r.*")

    @cached_property
    def samples(self) -> DataFrame:
        """(file_id, track, sample, offset, size, duration, decode_time, composition_time, is_sync, rank, gop): coded samples from 1 on;
        rank is the place in presentation order, gop the sample at which decoding must begin."""
        return self._each("samples").select("file_id", "track", F.explode("samples").alias("s")).select("file_id", "track", "s.*")

    @cached_property
    def errors(self) -> DataFrame:
        """(file_id, track, error): null where the track is sound."""
        return self._each("error").select("file_id", "track", "error")

    @cached_property
    def frames(self) -> DataFrame:
        """(file_id, track, frame, sample, time, duration): what is shown, in order, in ticks of the movie."""
        return self._each("frames").select("file_id", "track", F.posexplode("frames").alias("frame", "f")).select("file_id", "track", "frame", "f.*")

    @cached_property
    def info(self) -> DataFrame:
        """(file_id, track, role, frames, timescale, duration, repetitions, first_time, last_time, dependent, width, height)."""
        each = self._each("frames", "samples", "timescale", "length", "repetitions", "width", "height").where(F.size("frames") > 0)
        role = F.coalesce(*[F.when(F.col("track") == F.col(f"roles.{r}"), r) for r in ("image", "alpha", "thumbnail")])
        time = lambda i: F.element_at("frames", i)["time"]
        return each.select("file_id", "track", role.alias("role"), F.size("frames").cast("bigint").alias("frames"), F.coalesce("movie_timescale", "timescale").alias("timescale"), F.col("length").cast("decimal(20,0)").alias("duration"), "repetitions", time(1).alias("first_time"), time(-1).alias("last_time"), F.exists("samples", lambda s: ~s["is_sync"]).alias("dependent"), "width", "height").where("role is not null")

    @cached_property
    def alpha_matches(self) -> DataFrame:
        """(file_id, matches): whether the alpha track shows frames at the same times as the image track, and repeats like it."""
        return self.rows.where("matches is not null").select("file_id", "matches")

    @cached_property
    def usable(self) -> DataFrame:
        """(file_id, track, has_alpha, has_thumbnail): the image tracks of movies that can be shown; alpha has to be sound and to match."""
        return self.rows.where("usable").select("file_id", F.col("roles.image").alias("track"), F.col("roles.alpha").isNotNull().alias("has_alpha"), F.col("roles.thumbnail").isNotNull().alias("has_thumbnail"))


def lookup(c: Container, wanted: Column) -> DataFrame:
    """(file_id, track, wanted, offset, size, duration, decode_time, composition_time) of single samples, `wanted` being an array of numbers
    made of a file's row. Each is found by binary search over the runs of its track's tables; no track is unrolled, and no rows move. Numbers
    that a track lacks have nulls."""
    of = lambda t: F.transform(wanted, lambda n: let(tr.sample_at(t, n), lambda s: F.struct(t["track"].alias("track"), n.cast("bigint").alias("wanted"), *[s[k].alias(k) for k in ("offset", "size", "duration", "decode_time", "composition_time")])))
    found = F.flatten(F.transform("tracks", of))
    return c.raw.select("file_id", F.explode(found).alias("s")).select("file_id", "s.*")
