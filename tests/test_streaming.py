from spanweave.operators.stats import genome_identities
from spanweave.schema import FilterConfig
from spanweave.streaming import scan

from .helpers import line


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.paf").write_text("\n".join([line("A#1#x", 0, 100 + k, "B#1#x", 0, 100, 90, 100), line("s", 0, 10, "s", 0, 10, 9, 10), "bad"]) + "\n")
    stream = scan.stream_mappings(spark, str(tmp_path / "in"), FilterConfig(min_identity=0.5), files=1)
    q = scan.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3
    sums = scan.stream_identities(stream).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    sums.awaitTermination(120)
    assert spark.table("sums").first()["matches"] == genome_identities(out).first()["matches"] == 270
