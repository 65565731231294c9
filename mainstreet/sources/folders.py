"""Names in the folders of any store that Spark can open; the driver lists names and never reads rows."""


def _open(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark, path):
    system, place = _open(spark, path)
    return system.exists(place)


def subfolders(spark, path):
    """Names of the folders directly below ``path``, in order; none if there is no such path."""
    system, place = _open(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []


def data_files(spark, path):
    """(path, size, time of change) of the files at or below ``path``, in order, without those that Spark hides."""
    system, place = _open(spark, path)
    out = []
    for start in system.globStatus(place) or []:
        root = str(start.getPath())
        found = system.listFiles(start.getPath(), True)
        while found.hasNext():
            status = found.next()
            name = str(status.getPath())
            if not any(part[:1] in ("_", ".") for part in name[len(root) :].split("/") if "=" not in part):
                out.append((name, status.getLen(), status.getModificationTime()))
    return sorted(out)


def move(spark, source, target):
    """Give a folder or file its final name in one step; an error if the name is taken."""
    system, place = _open(spark, source)
    _, end = _open(spark, target)
    if system.exists(end) or not system.rename(place, end):
        raise FileExistsError(target)


def remove(spark, path):
    system, place = _open(spark, path)
    system.delete(place, True)


def read_note(spark, path):
    """The text of a small file, or None."""
    system, place = _open(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark, path, text):
    """A small file that is there in whole or not at all; ``path`` must be free."""
    system, place = _open(spark, path + ".part")
    stream = system.create(place, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    move(spark, path + ".part", path)
