"""Files opened where a task runs, by the URI that Spark lists them under."""

from __future__ import annotations


def opener():
    """Function from a listed path to (file system, path in it); local, so that it travels to the workers with its code."""

    def opened(path: str):
        from urllib.parse import quote

        import pyarrow.fs as pa_fs

        scheme, rest = path.split(":", 1)
        # a listed path is not escaped, and a local one has a single slash
        inside = rest.removeprefix("//") if rest.startswith("//") else rest
        return pa_fs.FileSystem.from_uri(f"{scheme}://{quote(inside, safe='/:@')}")

    return opened
