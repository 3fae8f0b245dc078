import zipfile

from colloquy.streaming.dropfolder import streamed_messages, watch_folder


def test_archives_are_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(name, text):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("a.txt", text)

    def run():
        watch_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(r.message for r in streamed_messages(spark, str(tmp_path / "out")).collect())

    drop("one.zip", "12/06/24, 9:16 - A: x\ny")
    assert run() == ["x y"]
    drop("two.zip", "12/06/24, 9:16 - A: z")
    assert run() == ["x y", "z"]
