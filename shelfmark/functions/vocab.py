"""Tag vocabulary: canonical keys and their names in three container dialects."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import ascii_lower, ascii_upper, col

_FREEFORM = "com.apple.iTunes"

# Canonical key, ID3 frame kind and name, MP4 atom kind and name.
# The Vorbis field name is the key in capitals.
VOCABULARY = (
    ("title", "text", "TIT2", "text", "©nam"),
    ("artist", "text", "TPE1", "text", "©ART"),
    ("album", "text", "TALB", "text", "©alb"),
    ("albumartist", "text", "TPE2", "text", "aART"),
    ("genre", "text", "TCON", "text", "©gen"),
    ("date", "text", "TDRC", "text", "©day"),
    ("composer", "text", "TCOM", "text", "©wrt"),
    ("grouping", "text", "TIT1", "text", "©grp"),
    ("tracknumber", "text", "TRCK", "number", "trkn"),
    ("discnumber", "text", "TPOS", "number", "disk"),
    ("comment", "comment", "COMM", "text", "©cmt"),
    ("lyrics", "lyrics", "USLT", "text", "©lyr"),
    ("copyright", "text", "TCOP", "freeform", "COPYRIGHT"),
    ("isrc", "text", "TSRC", "freeform", "ISRC"),
    ("lyricist", "text", "TEXT", "freeform", "LYRICIST"),
    ("conductor", "text", "TPE3", "freeform", "CONDUCTOR"),
    ("replaygain_track_gain", "txxx", "REPLAYGAIN_TRACK_GAIN", "freeform", "replaygain_track_gain"),
    ("replaygain_album_gain", "txxx", "REPLAYGAIN_ALBUM_GAIN", "freeform", "replaygain_album_gain"),
    ("replaygain_track_peak", "txxx", "REPLAYGAIN_TRACK_PEAK", "freeform", "replaygain_track_peak"),
    ("replaygain_album_peak", "txxx", "REPLAYGAIN_ALBUM_PEAK", "freeform", "replaygain_album_peak"),
    ("musicbrainz_albumid", "txxx", "MusicBrainz Album Id", "freeform", "MusicBrainz Album Id"),
    ("musicbrainz_artistid", "txxx", "MusicBrainz Artist Id", "freeform", "MusicBrainz Artist Id"),
    ("bpm", "text", "TBPM", "integer", "tmpo"),
    ("compilation", "text", "TCMP", "integer", "cpil"),
    ("gapless", "txxx", "GAPLESS", "integer", "pgap"),
)

# Byte widths of the MP4 number and integer atoms.
MP4_WIDTHS = {"trkn": 8, "disk": 6, "tmpo": 2, "cpil": 1, "pgap": 1}


def _literal_map(pairs: dict) -> Column:
    """Small constant map: a literal lookup needs neither join nor broadcast."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(_literal_map(pairs), key)


def canonical_key(dialect: str, kind, name) -> Column:
    """Canonical key of a native name, or null for a name outside the vocabulary.

    ID3 text frames and MP4 text and integer atoms are exact; TXXX descriptions,
    freeform names and Vorbis fields ignore ASCII case. MP4 number atoms are read
    by position elsewhere and never resolve here.
    """
    if dialect == "vorbis":
        return _lookup({v[0]: v[0] for v in VOCABULARY}, ascii_lower(name))
    at = 1 if dialect == "id3" else 3
    exact = ("text",) if dialect == "id3" else ("text", "integer")
    loose = "txxx" if dialect == "id3" else "freeform"
    k = col(kind)
    same = {f"{v[at]}:{v[at + 1]}": v[0] for v in VOCABULARY if v[at] in exact}
    near = {v[at + 1].lower(): v[0] for v in VOCABULARY if v[at] == loose}
    return F.when(k.isin(*exact), _lookup(same, F.concat(k, F.lit(":"), col(name)))).when(
        k == loose, _lookup(near, ascii_lower(name))
    )


def freeform_key(mean, name) -> Column:
    return F.when(ascii_lower(mean) == _FREEFORM.lower(), canonical_key("mp4", F.lit("freeform"), name))


def native_name(dialect: str, key) -> Column:
    """`kind:name` of a canonical key (any ASCII case) in a dialect; null when unknown."""
    k = ascii_lower(key)
    if dialect == "vorbis":
        return _lookup({v[0]: v[0].upper() for v in VOCABULARY}, k)
    at = 1 if dialect == "id3" else 3
    return _lookup({v[0]: f"{v[at]}:{v[at + 1]}" for v in VOCABULARY}, k)


def fold_field(name) -> Column:
    """Vorbis field name to key; unknown names stay as they are."""
    return F.coalesce(canonical_key("vorbis", None, name), col(name))


def compose_field(key, value) -> Column:
    field = F.coalesce(native_name("vorbis", key), ascii_upper(key))
    return F.concat(field, F.lit("="), col(value))


def vocabulary_frame(spark):
    return spark.createDataFrame(
        [(v[0], v[1], v[2], v[3], v[4], v[0].upper()) for v in VOCABULARY],
        "key string, id3_kind string, id3_name string, mp4_kind string, mp4_name string, vorbis_name string",
    )
