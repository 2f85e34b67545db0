"""Paths on any file system Spark can reach."""

import logging

log = logging.getLogger(__name__)


def _fs(spark, path):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def glob(spark, pattern):
    """Sorted paths that match a glob; empty when there are none."""
    fs, path = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))


def uri(spark, path):
    """The full name of a path, special characters encoded."""
    fs, path = _fs(spark, path)
    return fs.makeQualified(path).toUri().toString()


def exists(spark, path):
    fs, path = _fs(spark, path)
    return fs.exists(path)


def remove(spark, pattern):
    """Remove what matches a glob, folders with all they hold."""
    fs, _ = _fs(spark, pattern)
    for path in glob(spark, pattern):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def existing(spark, paths):
    return [p for p in paths if exists(spark, p)]
