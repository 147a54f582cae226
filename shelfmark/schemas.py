"""Closed vocabularies and row shapes of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed vocabularies of the catalog.
CATEGORIES_MOVIE = ("movies", "kids_movies")
CATEGORIES_TV = ("tv", "kids_shows", "fitness")
LAYOUTS_MOVIE = ("movie_flat", "movie_folder", "movie_collection_folder")
LAYOUTS_TV = ("tv_series_folder", "tv_season_folder")
LAYOUTS = (*LAYOUTS_MOVIE, *LAYOUTS_TV, "unknown")
MEDIA_EXTENSIONS = (
    ".mkv", ".mp4", ".m4v", ".mov", ".avi", ".mpg", ".mpeg", ".ts", ".m2ts", ".vob", ".wmv",
)
IGNORED_DIRECTORIES = (
    "__MACOSX", "@eaDir", "@Recycle", "#recycle", ".@__thumb", ".Trashes", ".Trash-1000",
)
FILE_STATES = ("ACTIVE", "MISSING")
CHANGE_TYPES = ("ADDED", "MISSING", "RESTORED", "UPDATED")
SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO")
FINDING_STATUSES = ("ACTIVE", "RESOLVED", "IGNORED")
CANDIDATE_TYPES = ("MOVIE", "EPISODE", "SPECIAL", "EXTRA", "UNKNOWN")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
ATTEMPT_STATUSES = ("RESOLVED", "REVIEW_REQUIRED", "NO_MATCH", "FAILED", "SKIPPED")
ASSIGNMENT_STATUSES = ("ACTIVE", "SUPERSEDED", "REVOKED")
PLAN_STATUSES = (
    "DRAFT", "READY_FOR_REVIEW", "REVIEW_REQUIRED", "APPROVED", "BLOCKED", "SUPERSEDED",
    "EXECUTING", "EXECUTED", "EXECUTION_FAILED", "RECOVERY_REQUIRED",
)
ACTION_TYPES = (
    "VALIDATE_SOURCE", "VERIFY_MEDIA", "CREATE_DIRECTORY", "RENAME", "MOVE",
    "REFRESH_INVENTORY", "REQUEST_PLEX_REFRESH",
)
PROPOSED = "PROPOSED_NOT_EXECUTED"

VIDEO_TRACK = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("aspect_ratio", T.StringType()),
    T.StructField("frame_rate", T.DoubleType()),
    T.StructField("hdr_format", T.StringType()),
    T.StructField("bit_depth", T.LongType()),
    T.StructField("scan_type", T.StringType()),
])
AUDIO_TRACK = T.StructType([
    T.StructField("codec", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("channels", T.LongType()),
    T.StructField("bitrate", T.LongType()),
    T.StructField("default", T.BooleanType()),
])
SUBTITLE_TRACK = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("default", T.BooleanType()),
    T.StructField("forced", T.BooleanType()),
])
# A listed file with its probe outcome; tracks stay nested on the file row, so counting,
# comparing and reading them back needs no join.
LISTED_FILE = T.StructType([
    T.StructField("library_id", T.LongType()),
    T.StructField("absolute_path", T.StringType()),
    T.StructField("relative_path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("parent_directory", T.StringType()),
    T.StructField("layout", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("container", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("overall_bitrate", T.LongType()),
    T.StructField("media_info_error", T.StringType()),
    T.StructField("video_tracks", T.ArrayType(VIDEO_TRACK)),
    T.StructField("audio_tracks", T.ArrayType(AUDIO_TRACK)),
    T.StructField("subtitle_tracks", T.ArrayType(SUBTITLE_TRACK)),
])
FILE_STATE = T.StructType([
    T.StructField("media_file_id", T.LongType()),
    *LISTED_FILE.fields,
    T.StructField("media_info_probed_at", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("first_seen_scan_id", T.LongType()),
    T.StructField("last_seen_scan_id", T.LongType()),
    T.StructField("missing_since_scan_id", T.LongType()),
])
