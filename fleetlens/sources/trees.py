"""Write rows as a file tree, so that scans can be run over derived data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .listing import file_system


def write_tree(files: DataFrame, root: str) -> None:
    """Write every (path, text) row to ``root/path``. Each task writes its own rows to the shared folder;
    a repeated task writes the same files again."""

    def write_rows(rows: Iterator) -> None:
        target, base = file_system(root)
        for row in rows:
            full = f"{base}/{row.path}"
            target.create_dir(full.rsplit("/", 1)[0], recursive=True)
            with target.open_output_stream(full) as out:
                out.write(row.text.encode("utf-8"))

    files.select("path", "text").foreachPartition(write_rows)
