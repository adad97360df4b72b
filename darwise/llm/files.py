"""Plain binary files in the folder driver and executors share."""

import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a path or URI."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def qualified(spark, path: str) -> str:
    """``path`` with the file system that Spark would take it for; tasks know no default file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def removed(spark, path: str) -> None:
    """Delete an intermediate table that nothing reads again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put(path: str, write) -> None:
    """``write(stream)`` into a file of its own, then rename: a task that is run again replaces the file whole."""
    import uuid

    system, at = place(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    mine = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(mine) as out:
        write(out)
    system.move(mine, at)


def mapped(path: str) -> pa.Buffer:
    """A whole file: memory-mapped where it is local, else read; ``FileNotFoundError`` if there is none."""
    system, at = place(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if not found.size:
        return pa.py_buffer(b"")
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(at) as source:
            return source.read_buffer()
    with system.open_input_file(at) as source:
        return source.read_buffer()
