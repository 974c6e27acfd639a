import pytest

from lexaspan.sources.fasta import query_list, read_sequences


def test_fasta(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">one two\nACGT\nac gt\r\n>\nTT\n>x>y\n\nGG>A\n")
    got = [(r.seq_id, r.seq_name, bytes(r.bytes)) for r in read_sequences(spark, str(f)).orderBy("seq_id").collect()]
    assert got == [(0, "one", b"ACGTacgt"), (1, "3", b"TT"), (2, "x>y", b"GG>A")]


def test_first_unnamed_record(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">\nTT\n")
    assert read_sequences(spark, str(f)).first().seq_name == "2"


def test_fastq(spark, tmp_path):
    f = tmp_path / "a.fq"
    f.write_text("@r1 d\nACGT\n+\n!!!!\n@r2\nGG\n+\n@@\n")
    got = [(r.seq_name, bytes(r.bytes)) for r in read_sequences(spark, str(f)).orderBy("seq_id").collect()]
    assert got == [("r1", b"ACGT"), ("r2", b"GG")]


def test_empty_file_is_an_error(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text("\n")
    with pytest.raises(ValueError):
        read_sequences(spark, str(f))


def test_query_list(spark, tmp_path):
    f = tmp_path / "q.txt"
    f.write_text("AC\n GT  TT\n")
    got = [tuple(r) for r in query_list(spark, ["X", str(f), "Y"]).collect()]
    assert got == [(0, "X"), (1, "AC"), (2, "GT"), (3, "TT"), (4, "Y")]


def test_splits_of_a_file_keep_their_order(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text("".join(f">r{i}\n{'ACGT' * (i % 7)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [(r.seq_name, bytes(r.bytes)) for r in read_sequences(spark, str(f)).orderBy("seq_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(f"r{i}", b"ACGT" * (i % 7)) for i in range(500)]


def test_fastq_files_apart(spark, tmp_path):
    d = tmp_path / "reads"
    d.mkdir()
    (d / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\n\n+\n\n@r3\nGG\n+r3\nII\n\n\n")
    (d / "b.fq").write_text("@x\r\nTT\r\n+\r\n@+\r\n@y\n\n+\n")
    got = [(r.seq_name, bytes(r.bytes)) for r in read_sequences(spark, str(d)).orderBy("seq_id").collect()]
    assert got == [("r1", b"ACGT"), ("r2", b""), ("r3", b"GG"), ("x", b"TT"), ("y", b"")]


@pytest.mark.parametrize("text", ["@r\nAC\n+\nI\n", "@r\nAC\nII\n+\n", "@r\nAC\n", "@r\nAC\n+\nII\nr2\nAC\n+\nII\n"])
def test_broken_fastq_is_an_error(spark, tmp_path, text):
    f = tmp_path / "a.fq"
    f.write_text(text)
    with pytest.raises(Exception, match="no FASTQ record"):
        read_sequences(spark, str(f)).collect()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexaspan.runtime import shared_dir

    class Context(SimpleNamespace):
        def getCheckpointDir(self):
            return self.folder

    session = lambda master, conf, folder: SimpleNamespace(conf={"spark.checkpoint.dir": conf} if conf else {}, sparkContext=Context(master=master, applicationId=f"none-{master}", folder=folder))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", None, None))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[2,1,1024]", None, None))
    assert shared_dir(session("yarn", None, "hdfs://x/mine")) == "hdfs://x/mine"
    assert shared_dir(session("yarn", "hdfs://x/conf/", "hdfs://x/mine")) == "hdfs://x/conf"
