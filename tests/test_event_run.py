from shelfmark.schemas import ART, COLLECTION, LIBRARY_EVENT, STRUCTURAL_BLOCKS, TAGS, TRACK_ART, TRACKS
from shelfmark.streaming.events import EventRun

OWNER = "collection_managed"


def event(i, kind, added=None, now=None, before=None, artist="1", album_mbid=None, artist_mbid=None):
    return (i, kind, added, now, before, artist, None, album_mbid, artist_mbid)


EVENTS = [
    event(1, "AlbumDeleted", album_mbid="old-2"),  # track 2 goes by its stored tag, the sync of event 3 comes too late
    event(2, "ArtistDeleted", artist_mbid="AR"),  # before the sync: nobody has it yet, and 6 is not owned
    event(3, "AlbumDownload", added="/m/1|/m/2|/m/nofile|/m/bare"),
    event(4, "Rename", now="/m/twice", before="/m/3"),  # rejected whole, so /m/3 stays
    event(5, "Rename", now="/m/4", before="/m/5|/m/7"),  # 5 is gone from disk, 7 still there
    event(6, "AlbumDeleted", album_mbid="old-1"),  # merged tags keep the album id: track 1 goes after its sync
    event(7, "AlbumDownload", added="/m/4", artist=None),
    event(8, "TrackRetag"),
    event(9, "Test"),
    event(10, "Grab", added="/m/4"),
]


def setting(spark):
    track = lambda i, p: (i, p, "mp3", 0, 1, 1, 1, 1, 0, 0, None, None)
    tags = [(i, "title", "mine", 0, None) for i in range(1, 9)]
    tags += [(i, "musicbrainz_albumid", f"old-{i}", 0, None) for i in (1, 2)] + [(i, OWNER, "1", 0, None) for i in (1, 2)]
    tags += [(6, "musicbrainz_artistid", "AR", 0, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalogue = {
        "tracks": frame([track(i, f"/m/{i}") for i in range(1, 8)] + [track(8, "/m/twice")], TRACKS), "tags": frame(tags, TAGS),
        "art": frame([], ART), "track_art": frame([(1, 1, 3, "", 0), (4, 1, 3, "", 0)], TRACK_ART), "structural_blocks": frame([], STRUCTURAL_BLOCKS),
    }
    files = [(10, "1", "1", "/m/1"), (20, "1", "1", "/m/2"), (40, "1", "1", "/m/4"), (80, "1", "1", "/m/twice"), (81, "1", "1", "/m/twice"), (90, "1", "1", "/m/bare")]
    linked = [(i, None, None, i, None, None, None, str(i), None, f"T{i}") for i in (10, 20, 40, 80, 81)]
    collection = {
        "files": frame(files, COLLECTION["files"]), "tracks": frame(linked, COLLECTION["tracks"]),
        "albums": frame([("1", "Album", None, None, [], None, None, None, None)], COLLECTION["albums"]), "artists": frame([("1", "Artist", None, "AR", None, [])], COLLECTION["artists"]),
    }
    return catalogue, collection, frame([(f"/m/{i}",) for i in (1, 2, 4, 6, 7)], "path string")


def outcome(run):
    now = run.current()
    tags = {(r.track_id, r.key, r.value) for r in now["tags"].collect()}
    versions = {r.id: r.content_version for r in now["tracks"].collect()}
    return tags, versions, {r.track_id for r in now["track_art"].collect()}, {(r.event_id, r.path, r.reason) for r in run.rejects().collect()}


def test_one_batch_several_and_repeated_ones_agree(spark, tmp_path):
    catalogue, collection, inventory = setting(spark)
    run = lambda name: EventRun(spark, str(tmp_path / name), lambda: catalogue, lambda: collection, lambda: inventory)
    batch = lambda rows: spark.createDataFrame(rows, LIBRARY_EVENT)
    one = run("one")
    one.apply(batch(EVENTS), 0)
    tags, versions, pictures, rejects = outcome(one)
    assert set(versions) == {3, 4, 6, 7, 8}
    assert {t for t in tags if t[0] == 4} == {(4, "title", "T40"), (4, "artist", "Artist"), (4, "albumartist", "Artist"), (4, "album", "Album"), (4, "tracknumber", "40"), (4, "musicbrainz_artistid", "AR"), (4, OWNER, "1")}
    assert {t for t in tags if t[0] != 4} == {(i, "title", "mine") for i in (3, 6, 7, 8)} | {(6, "musicbrainz_artistid", "AR")}
    assert pictures == {4}
    assert rejects == {
        (3, "/m/nofile", "no matching track file"), (3, "/m/bare", "multi-track metadata unavailable"), (4, "/m/twice", "several collection files"), (7, None, "no artist or album id"),
    }
    # A batch that is repeated, or broke off before it said what it touched, changes nothing.
    one.apply(batch(EVENTS), 0)
    assert outcome(one) == (tags, versions, pictures, rejects)
    # A later delete finds what the sync wrote; the track's children go with it.
    one.apply(batch([event(11, "ArtistDeleted", artist_mbid="AR")]), 1)
    after = outcome(one)
    assert set(after[1]) == {3, 6, 7, 8} and after[2] == set()
    one.apply(batch([event(11, "ArtistDeleted", artist_mbid="AR")]), 1)
    assert outcome(one) == after
    # The same events cut into batches.
    many = run("many")
    for n, (low, high) in enumerate(((0, 2), (2, 5), (5, 10))):
        many.apply(batch(EVENTS[low:high]), n)
    assert outcome(many) == (tags, versions, pictures, rejects)
