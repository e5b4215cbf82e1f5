import pytest

from shelfmark.operators import children as CH
from shelfmark.plans import scan as SC
from shelfmark.schemas import ART, MAX_BLOB_BYTES, STRUCTURAL_BLOCKS, TAGS, TRACK_ART, TRACKS

FILES = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, fingerprint string, content_hash string"
PICTURES = "path string, pos bigint, mime string, width int, height int, picture_type int, description string, data binary"
BINARY = "path string, pos bigint, key string, payload binary"
BLOCKS = "path string, pos bigint, kind string, body binary"
TEXT = "path string, pos bigint, key string, value string"


def stored(i, path, **kw):
    row = {"fmt": "flac", "mtime": 1, "fp": None, "ch": None} | kw
    return (i, path, row["fmt"], 0, 10, 10, row["mtime"], row["mtime"], 0, 5, row["fp"], row["ch"])


def catalogue(spark, tracks=(), tags=(), art=(), links=(), blocks=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {"tracks": frame(tracks, TRACKS), "tags": frame(tags, TAGS), "art": frame(art, ART), "track_art": frame(links, TRACK_ART), "structural_blocks": frame(blocks, STRUCTURAL_BLOCKS)}


def listed(spark, *rows):
    return spark.createDataFrame([(p, 10, m, m, None, None) for p, m in rows], FILES)


def test_pictures_share_art_and_bad_ones_are_reported(spark):
    import hashlib

    old = hashlib.sha256(b"old").hexdigest()
    cat = catalogue(spark, [stored(7, "/m/a.flac")], art=[(4, old, "image/stored", 1, 1, 3, b"old")], links=[(7, 4, 3, "was", 0)])
    pics = [
        ("/m/a.flac", 5, "image/png", 0, 9, 3, "x", b"old"),
        ("/m/a.flac", 6, "image/png", 1, 1, 99, None, b"new"),
        ("/m/b.flac", 0, "image/gif", 1, 1, 0, "", bytes(MAX_BLOB_BYTES + 1)),
        ("/m/b.flac", 1, "image/gif", 2, 0, 0, "", b"new"),
        ("/m/b.flac", 2, "image/gif", 2, 0, 0, "d" * 1025, b"new"),
        ("/m/b.flac", 3, "image/gif", 2, 0, 0, "", None),
        ("/elsewhere.flac", 0, "image/gif", 2, 0, 0, "", b"lost"),
    ]
    out = SC.scan(listed(spark, ("/m/a.flac", 1), ("/m/b.flac", 1)), cat, 99, force=True, file_pictures=spark.createDataFrame(pics, PICTURES))
    art = {r.id: (r.mime, r.width, r.height, bytes(r.data)) for r in out.catalogue["art"].collect()}
    # The stored row keeps its attributes; the new one has those of the first file by path.
    assert art == {4: ("image/stored", 1, 1, b"old"), 5: ("image/png", 1, 1, b"new")}
    links = {(r.track_id, r.art_id, r.picture_type, r.description, r.ordinal) for r in out.catalogue["track_art"].collect()}
    assert links == {(7, 4, 3, "x", 0), (7, 5, 0, "", 1), (8, 5, 0, "", 0)}
    got = {(r.path, r.table, r.pos, r.reason) for r in out.rejects.collect()}
    assert got == {("/m/b.flac", "track_art", 0, "oversize"), ("/m/b.flac", "track_art", 2, "description"), ("/m/b.flac", "track_art", 3, "oversize")}
    # One link removed and two added on track 7, one added on track 8.
    assert {r.id: r.content_version for r in out.catalogue["tracks"].collect()} == {7: 3, 8: 1}


def test_each_kind_is_replaced_alone(spark):
    tags = [(7, "title", "old", 0, None), (7, "id3:PRIV", "", 0, b"old"), (1, "title", "other", 0, None)]
    cat = catalogue(spark, [stored(7, "/m/a.flac"), stored(1, "/x/b.flac")], tags, blocks=[(7, "STREAMINFO", 0, b"old"), (1, "STREAMINFO", 0, b"other")])
    files = listed(spark, ("/m/a.flac", 1))
    rows = lambda out: {(r.track_id, r.key, r.value, r.ordinal, r.value_blob and bytes(r.value_blob)) for r in out.catalogue["tags"].collect()}
    blobs = spark.createDataFrame([("/m/a.flac", 3, "b", b"1"), ("/m/a.flac", 4, "a", b""), ("/m/a.flac", 5, "a", b"2"), ("/m/a.flac", 6, "bad\n", b"3")], BINARY)
    out = SC.scan(files, cat, 9, force=True, file_binary_tags=blobs)
    assert rows(out) == {(7, "title", "old", 0, None), (7, "b", "", 0, b"1"), (7, "a", "", 1, b"2"), (1, "title", "other", 0, None)}
    assert [(r.pos, r.reason) for r in out.rejects.collect()] == [(6, "key_control")]
    text = spark.createDataFrame([("/m/a.flac", 1, "title", "new"), ("/m/a.flac", 0, "", "no")], TEXT)
    out = SC.scan(files, cat, 9, force=True, file_tags=text)
    assert rows(out) == {(7, "title", "new", 0, None), (7, "id3:PRIV", "", 0, b"old"), (1, "title", "other", 0, None)}
    blocks = spark.createDataFrame([("/m/a.flac", 9, "SEEKTABLE", b"s2"), ("/m/a.flac", 2, "SEEKTABLE", b"s1"), ("/m/a.flac", 1, "PADDING", b"p")], BLOCKS)
    out = SC.scan(files, cat, 9, force=True, file_blocks=blocks)
    got = {(r.track_id, r.kind, r.ordinal, bytes(r.body)) for r in out.catalogue["structural_blocks"].collect()}
    assert got == {(7, "SEEKTABLE", 0, b"s1"), (7, "SEEKTABLE", 1, b"s2"), (1, "STREAMINFO", 0, b"other")}
    assert rows(out) == set(tags)
    # Empty inputs replace as well: the file brought none.
    out = SC.scan(files, cat, 9, force=True, file_blocks=blocks.limit(0), file_tags=text.limit(0), file_binary_tags=blobs.limit(0))
    assert rows(out) == {(1, "title", "other", 0, None)}
    assert {r.track_id for r in out.catalogue["structural_blocks"].collect()} == {1}


def test_revalidate_brings_back_blocks_and_settles(spark):
    tags = [(7, "title", "mine", 0, None), (7, "id3:PRIV", "", 0, b"mine")]
    cat = catalogue(spark, [stored(7, "/m/a.flac"), stored(8, "/m/b.mp3", fmt="mp3"), stored(9, "/m/c.flac", mtime=5)], tags, blocks=[(9, "STREAMINFO", 0, b"stale"), (8, "STREAMINFO", 0, b"kept")])
    files = listed(spark, ("/m/a.flac", 1), ("/m/b.mp3", 1), ("/m/c.flac", 6))
    read = spark.createDataFrame([(p, n, k, k.encode()) for p in ("/m/a.flac", "/m/b.mp3", "/m/c.flac") for n, k in enumerate(("STREAMINFO", "SEEKTABLE"))], BLOCKS)
    out = SC.revalidate(files, cat, 9, "/m", file_blocks=read)
    assert tuple(out.stats.head()) == (2, 1, 0)
    got = {(r.track_id, r.kind, bytes(r.body)) for r in out.catalogue["structural_blocks"].collect()}
    assert got == {(i, k, k.encode()) for i in (7, 9) for k in ("STREAMINFO", "SEEKTABLE")} | {(8, "STREAMINFO", b"kept")}
    assert {(r.key, r.value) for r in out.catalogue["tags"].collect()} == {("title", "mine"), ("id3:PRIV", "")}
    # Two rows added; for c one removed, two added and its stamp moved.
    assert {r.id: r.content_version for r in out.catalogue["tracks"].collect()} == {7: 2, 8: 0, 9: 4}
    assert tuple(SC.revalidate(files, out.catalogue, 10, "/m", file_blocks=read).stats.head()) == (0, 3, 0)


def test_failed_and_raced_files_change_nothing(spark):
    cat = catalogue(spark, [stored(1, "/m/known.mp3", fmt="mp3"), stored(2, "/m/unseen.mp3", fmt="mp3"), stored(3, "/m/gone.mp3", fmt="mp3"), stored(4, "/m/torn.mp3", fmt="mp3")])
    rows = [
        ("/m/known.mp3", "present", "failed", 1), ("/m/new.mp3", "present", None, 1), ("/m/bad.mp3", None, "failed", 1), ("/m/torn.mp3", "present", "raced", 2),
        ("/m/swap.mp3", "present", "raced", 1), ("/m/unseen.mp3", "unknown", None, None), ("/m/away.mp3", "absent", None, None), ("/m/x.txt", "present", "failed", 1), ("/m/dir", "unknown", None, None),
    ]
    files = spark.createDataFrame([(p, 10 if m else None, m, m, seen, probe) for p, seen, probe, m in rows], "path string, size bigint, mtime_ns bigint, ctime_ns bigint, presence string, probe string")
    out = SC.scan(files, cat, 9, roots=["/m"])
    assert out.stats.head().asDict() == {"scanned": 1, "inserted": 1, "retargeted": 0, "updated": 0, "skipped": 1, "already_present": 2, "failed": 3, "raced": 1}
    assert {r.backing_path for r in out.catalogue["tracks"].collect()} == {"/m/known.mp3", "/m/unseen.mp3", "/m/gone.mp3", "/m/torn.mp3", "/m/new.mp3"}
    out = SC.revalidate(files, cat, 9, "/m", prune=True)
    # known.mp3 is unchanged, so it was not read; torn.mp3 changed while it was.
    assert out.stats.head().asDict() == {"updated": 0, "unchanged": 1, "pruned": 1, "failed": 2, "raced": 1}
    assert {(r.id, r.backing_mtime_ns) for r in out.catalogue["tracks"].collect()} == {(1, 1), (2, 1), (4, 1)}


def test_a_file_without_fingerprint_is_known_by_its_content(spark):
    files = listed(spark, ("/m/a.flac", 1), ("/m/b.flac", 1))
    text = lambda *rows: spark.createDataFrame([(p, n, "title", v) for p, n, v in rows], TEXT)
    first = SC.scan(files, catalogue(spark), 9, file_tags=text(("/m/a.flac", 0, "A"), ("/m/b.flac", 0, "B")), content_fingerprints=True, roots=["/m"])
    ids = {r.backing_path: r.id for r in first.catalogue["tracks"].collect()}
    assert len({r.fingerprint for r in first.catalogue["tracks"].collect()}) == 2
    moved = SC.scan(listed(spark, ("/n/a.flac", 1), ("/m/b.flac", 1)), first.catalogue, 10, file_tags=text(("/n/a.flac", 0, "A")), content_fingerprints=True, roots=["/m", "/n"])
    assert moved.stats.head().retargeted == 1
    assert {r.backing_path: r.id for r in moved.catalogue["tracks"].collect()} == {"/n/a.flac": ids["/m/a.flac"], "/m/b.flac": ids["/m/b.flac"]}
    other = SC.scan(listed(spark, ("/n/a.flac", 1), ("/m/b.flac", 1)), first.catalogue, 10, file_tags=text(("/n/a.flac", 0, "other")), content_fingerprints=True, roots=["/m", "/n"])
    assert other.stats.head().inserted == 1


@pytest.mark.parametrize("pos", [range(5), (4, 2, 0, 9, 7)])
def test_block_ordinals_follow_positions(spark, pos):
    rows = spark.createDataFrame([("/a", 1, p, "SEEKTABLE", str(p).encode()) for p in pos], "path string, track_id bigint, pos bigint, kind string, body binary")
    got = [bytes(r.body) for r in CH.file_blocks(rows).orderBy("ordinal").collect()]
    assert got == [str(p).encode() for p in sorted(pos)]
