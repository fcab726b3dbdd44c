"""Files that tasks write and read in the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from leadloom.session import checkpoint_dir


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there; a folder without a scheme is a path."""
    if re.match(r"\w[\w+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", folder))
    return fs.LocalFileSystem(), folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """An empty folder that driver and executors share."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    return folder
