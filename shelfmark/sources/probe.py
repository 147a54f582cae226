"""Probe payloads (JSON per file) decoded into metadata or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payload members that are read, by track kind.
TRACK_DDL = (
    "`@type` string, Format string, Duration string, OverallBitRate string, Width string, "
    "Height string, `DisplayAspectRatio/String` string, DisplayAspectRatio string, "
    "FrameRate string, HDR_Format string, BitDepth string, ScanType string, Language string, "
    "Channels string, BitRate string, `Default` string, Forced string"
)


def text(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def whole(value: Column) -> Column:
    return number(value).try_cast("long")


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "yes", F.lit(False))


def _video(t: Column) -> Column:
    return F.struct(
        text(t["Format"]).alias("codec"), whole(t["Width"]).alias("width"), whole(t["Height"]).alias("height"),
        F.coalesce(text(t["DisplayAspectRatio/String"]), text(t["DisplayAspectRatio"])).alias("aspect_ratio"),
        number(t["FrameRate"]).alias("frame_rate"), text(t["HDR_Format"]).alias("hdr_format"),
        whole(t["BitDepth"]).alias("bit_depth"), text(t["ScanType"]).alias("scan_type"),
    )


def _audio(t: Column) -> Column:
    return F.struct(
        text(t["Format"]).alias("codec"), text(t["Language"]).alias("language"),
        whole(t["Channels"]).alias("channels"), whole(t["BitRate"]).alias("bitrate"),
        flag(t["Default"]).alias("default"),
    )


def _subtitle(t: Column) -> Column:
    return F.struct(text(t["Language"]).alias("language"), flag(t["Default"]).alias("default"),
                    flag(t["Forced"]).alias("forced"))


def decode(df: DataFrame, payload: str = "payload", error: str | None = None) -> DataFrame:
    """Add the decoded metadata, or ``media_info_error``; a bad payload never fails the job.

    ``error`` names a column holding the prober's own failure text. A null payload without one
    is a file that was not probed, and gets neither metadata nor an error. Metadata columns are
    null beside an error.
    """
    raw, kept = F.col(payload), df.columns
    listing = F.get_json_object(raw, "$.media.track")
    # One track may stand as a bare object where a list is expected.
    wrapped = F.when(F.startswith(F.ltrim(listing), F.lit("{")), F.concat(F.lit("["), listing, F.lit("]"))).otherwise(listing)
    own_error = F.col(error) if error else F.lit(None).cast("string")
    df = df.withColumn("__own", own_error).withColumn("__tracks", F.from_json(wrapped, f"array<struct<{TRACK_DDL.replace(' string', ':string')}>>"))
    tracks = F.col("__tracks")

    def of(kind):
        return F.filter(tracks, lambda t: t["@type"] == kind)

    general = F.get(of("General"), F.lit(0))
    root = F.get_json_object(raw, "$.media")
    problem = (
        F.when(F.col("__own").isNotNull(), F.col("__own"))
        .when(raw.isNull(), F.lit(None))
        .when(root.isNull(), "unreadable probe output: no media object")
        .when(tracks.isNull(), "unreadable probe output: no track list")
        .when(general.isNull(), "unreadable probe output: no General track")
    )
    df = df.withColumn("media_info_error", problem).withColumn("__general", general)
    good = F.col("__own").isNull() & raw.isNotNull() & F.col("media_info_error").isNull()
    g = F.col("__general")
    decoded = {
        "container": F.when(good, text(g["Format"])),
        "duration_seconds": F.when(good, number(g["Duration"])),
        "overall_bitrate": F.when(good, whole(g["OverallBitRate"])),
        "video_tracks": F.when(good, F.transform(of("Video"), _video)),
        "audio_tracks": F.when(good, F.transform(of("Audio"), _audio)),
        "subtitle_tracks": F.when(good, F.transform(of("Text"), _subtitle)),
        "media_info_error": F.col("media_info_error"),
    }
    # A one-row generator: a filter on a decoded column would otherwise be pushed below the
    # decoding and parse every payload again.
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in decoded.items()]))))
