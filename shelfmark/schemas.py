"""Table schemas and fixed limits of the catalogue."""

from pyspark.sql import types as T

# Container formats a track may have, and the file extensions a scan accepts.
FORMATS = ("flac", "mp3", "m4a", "opus", "vorbis", "oggflac", "wav")
EXTENSIONS = ("flac", "mp3", "m4a", "m4b", "ogg", "oga", "opus", "wav")
BLOCK_KINDS = ("STREAMINFO", "SEEKTABLE")

# Size limits.
MAX_KEY_CHARS = 256
MAX_VALUE_BYTES = 262144
MAX_BLOB_BYTES = 16711680
MAX_MIME_CHARS = 255
MAX_DESCRIPTION_CHARS = 1024
MAX_BLOCK_BYTES = 16777215
MAX_ROWS_PER_TRACK = 4096
MAX_PICTURE_TYPE = 20
LOG_RING = 8192
NAME_BYTES = 255
PATH_FIELD_SEGMENTS = 64
SECTION_DEPTH = 64
MAX_SUFFIX = 4294967295


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TRACKS = _struct(
    ("id", T.LongType(), False),
    ("backing_path", T.StringType(), False),
    ("format", T.StringType(), False),
    ("audio_offset", T.LongType(), False),
    ("audio_length", T.LongType(), False),
    ("backing_size", T.LongType(), False),
    ("backing_mtime_ns", T.LongType(), False),
    ("backing_ctime_ns", T.LongType(), False),
    ("content_version", T.LongType(), False),
    ("updated_at", T.LongType(), False),
    ("fingerprint", T.StringType(), True),
    ("content_hash", T.StringType(), True),
)

TAGS = _struct(
    ("track_id", T.LongType(), False),
    ("key", T.StringType(), False),
    ("value", T.StringType(), False),
    ("ordinal", T.LongType(), False),
    ("value_blob", T.BinaryType(), True),
)

ART = _struct(
    ("id", T.LongType(), False),
    ("sha256", T.StringType(), False),
    ("mime", T.StringType(), False),
    ("width", T.IntegerType(), True),
    ("height", T.IntegerType(), True),
    ("byte_len", T.LongType(), False),
    ("data", T.BinaryType(), False),
)

TRACK_ART = _struct(
    ("track_id", T.LongType(), False),
    ("art_id", T.LongType(), False),
    ("picture_type", T.IntegerType(), False),
    ("description", T.StringType(), False),
    ("ordinal", T.LongType(), False),
)

STRUCTURAL_BLOCKS = _struct(
    ("track_id", T.LongType(), False),
    ("kind", T.StringType(), False),
    ("ordinal", T.LongType(), False),
    ("body", T.BinaryType(), False),
)

TRACK_CHANGES = _struct(("seq", T.LongType(), False), ("track_id", T.LongType(), False))

CATALOGUE = {
    "tracks": TRACKS,
    "tags": TAGS,
    "art": ART,
    "track_art": TRACK_ART,
    "structural_blocks": STRUCTURAL_BLOCKS,
    "track_changes": TRACK_CHANGES,
}

# State kept between refreshes of the rendered view.
SNAPSHOT = _struct(
    ("id", T.LongType(), False),
    ("content_version", T.LongType(), False),
    ("format", T.StringType(), False),
    ("path", T.StringType(), False),
)

# JSON records of the collection manager's API (fixed field names of the wire format).
COLLECTION_ARTIST = _struct(
    ("id", T.StringType(), True),
    ("artistName", T.StringType(), True),
    ("name", T.StringType(), True),
    ("foreignArtistId", T.StringType(), True),
    ("mbId", T.StringType(), True),
    ("genres", T.ArrayType(T.StringType()), True),
)
COLLECTION_IMAGE = _struct(
    ("coverType", T.StringType(), True),
    ("url", T.StringType(), True),
    ("remoteUrl", T.StringType(), True),
)
COLLECTION_ALBUM = _struct(
    ("id", T.StringType(), True),
    ("title", T.StringType(), True),
    ("foreignAlbumId", T.StringType(), True),
    ("releaseDate", T.StringType(), True),
    ("genres", T.ArrayType(T.StringType()), True),
    ("artistId", T.StringType(), True),
    ("artist_id", T.StringType(), True),
    ("artist", _struct(("artistId", T.StringType(), True), ("id", T.StringType(), True)), True),
    ("images", T.ArrayType(COLLECTION_IMAGE), True),
)
COLLECTION_FILE = _struct(
    ("id", T.LongType(), True),
    ("artistId", T.StringType(), True),
    ("albumId", T.StringType(), True),
    ("path", T.StringType(), True),
)
COLLECTION_TRACK = _struct(
    ("id", T.LongType(), True),
    ("artistId", T.StringType(), True),
    ("albumId", T.StringType(), True),
    ("trackFileId", T.LongType(), True),
    ("foreignTrackId", T.StringType(), True),
    ("foreignRecordingId", T.StringType(), True),
    ("trackNumber", T.StringType(), True),
    ("absoluteTrackNumber", T.StringType(), True),
    ("mediumNumber", T.StringType(), True),
    ("title", T.StringType(), True),
)
COLLECTION = {
    "artists": COLLECTION_ARTIST,
    "albums": COLLECTION_ALBUM,
    "files": COLLECTION_FILE,
    "tracks": COLLECTION_TRACK,
}

LIBRARY_EVENT = _struct(
    ("event_id", T.LongType(), False),
    ("raw_type", T.StringType(), True),
    ("added_paths", T.StringType(), True),
    ("file_paths", T.StringType(), True),
    ("previous_paths", T.StringType(), True),
    ("artist_id", T.StringType(), True),
    ("album_id", T.StringType(), True),
    ("album_mbid", T.StringType(), True),
    ("artist_mbid", T.StringType(), True),
)
