from duewise.llm import token_files


def test_starts_by_the_file_name_only(spark):
    # The folder and the job's UUID hold what the file's own number looks like.
    name = "file:/w/token-files-c3part-7-c1/files/part-{:05d}-1a2b-4c3d-c5e6-c777-0123456789ab-c{:03d}.txt"
    rows = [(name.format(p, c), d, 10 * d, d + 1) for d, (p, c) in enumerate([(0, 2), (1, 0), (0, 0), (0, 1)])]
    df = spark.createDataFrame(rows, "file string, doc_id long, place long, n_tokens long")
    got = {r.doc_id: r.start - r.place for r in token_files.with_starts(spark, df).collect()}
    assert got == {2: 0, 3: 3, 0: 7, 1: 8}
