"""Folders and renames: what a file system refuses must not pass for done."""

import types

import pytest

from cladewise.functions import schema, storage


class Files:
    """A file system in a dictionary; renames to or from `refused` fail by their result."""

    def __init__(self, held, refused=()):
        self.held, self.refused = dict(held), refused

    def exists(self, path):
        return path in self.held

    def delete(self, path, recursive):
        return self.held.pop(path, None) is not None

    def rename(self, a, b):
        if a in self.refused or a not in self.held or b in self.held:
            return False
        self.held[b] = self.held.pop(a)
        return True


def test_replace():
    files = Files({"new": 2, "at": 1, "old": 0})
    storage.replace(files, "new", "at", "old")
    assert files.held == {"at": 2}
    files = Files({"new": 2})
    storage.replace(files, "new", "at", "old")
    assert files.held == {"at": 2}


@pytest.mark.parametrize("refused", ["new", "at"])
def test_a_refused_rename_is_an_error_and_loses_nothing(refused):
    files = Files({"new": 2, "at": 1}, (refused,))
    with pytest.raises(OSError):
        storage.replace(files, "new", "at", "old")
    assert files.held["at"] == 1 and files.held["new"] == 2


def test_scratch_is_never_local_on_a_cluster():
    def session(conf, folder, master):
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: conf or default), sparkContext=context)

    assert storage.scratch(session("s3://a/", None, "yarn"), "x").startswith("s3://a/x-")
    assert storage.scratch(session("", "hdfs:///b", "yarn"), "x").startswith("hdfs:///b/x-")
    with pytest.raises(RuntimeError):
        storage.scratch(session("", None, "yarn"), "x")


@pytest.mark.parametrize("wrong", [{"floor": 0}, {"max_copies": -1}, {"max_ratio": 0.0}, {"max_ratio": 1.5}, {"seed": -1}, {"seed": 2**64}])
def test_oversampling_bounds(wrong):
    with pytest.raises(ValueError):
        schema.Oversampling(**wrong)
    assert schema.Oversampling(max_copies=0).max_copies == 0
