"""What survives a task that runs twice, and work folders."""

from tidefold.llm import token_files
from tidefold.llm.common import shared_dir, work_path


def test_files_of_a_repeated_task_do_no_harm(documents):
    """Files that a lost attempt left in the folder are not read: Spark's commit names what counts."""
    first, second = token_files.write_tokens(documents), token_files.write_tokens(documents)
    assert set(first.inputFiles()).isdisjoint(second.inputFiles())
    one, two = (sorted(map(tuple, token_files.read_tokens(table).collect())) for table in (first, second))
    assert one == two and len(one) == documents.count()


def test_the_shared_folder_is_the_sessions(spark):
    path = shared_dir(spark)
    assert path == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    one, two = work_path(spark, "x"), work_path(spark, "x")
    assert one != two and one.startswith("file:") and path.removeprefix("file:").lstrip("/") in one
