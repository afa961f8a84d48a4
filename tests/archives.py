"""Archives for the tests, byte by byte."""

from folioscope.sources import layout


def content(path, cluster, blob, title="", ns="A", type_=0):
    return {"type": type_, "namespace": ns, "path": path, "title": title, "cluster_id": cluster, "blob_id": blob}


def redirect(path, to, title="", ns="A"):
    return {"type": layout.REDIRECT, "namespace": ns, "path": path, "title": title, "redirect_id": to}


def marker(kind):
    return {"type": kind}


def write(folder, name, entries, clusters=(), mimes=("text/html", "image/png"), **options):
    path = folder / name
    path.write_bytes(layout.build(entries, list(mimes), list(clusters), **options))
    return str(path)
