"""Files of the sink get their names without the lock that renames between folders take."""

import os

import pyarrow.fs as pafs

from loomshed.sources import trees


class Unmoved(pafs.LocalFileSystem):
    """A local file system whose renames fail, for they wait for one lock of all of it."""

    def move(self, *a):
        raise AssertionError("renamed")


def test_a_new_file_of_a_local_tree_is_linked(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "t").write_bytes(b"x")
    trees._moved(Unmoved(), f"{tmp_path}/t", f"{tmp_path}/d/f")
    assert os.listdir(tmp_path) == ["d"] and (tmp_path / "d/f").read_bytes() == b"x"


def test_a_file_that_is_there_is_replaced_and_a_link_made_before_is_kept(tmp_path):
    fs, _ = trees.opened(str(tmp_path))
    for data in (b"one", b"two"):
        (tmp_path / "t").write_bytes(data)
        trees._moved(fs, f"{tmp_path}/t", f"{tmp_path}/f")
        assert (tmp_path / "f").read_bytes() == data and not (tmp_path / "t").exists()
    os.link(tmp_path / "f", tmp_path / "t")  # an attempt that ended between the link and the removal
    trees._moved(fs, f"{tmp_path}/t", f"{tmp_path}/f")
    assert (tmp_path / "f").read_bytes() == b"two"
