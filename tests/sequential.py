"""The naming rule told one track after another; the tests compare the set form with it."""


def cut(text, limit):
    raw = text.encode()
    return text if len(raw) <= limit else raw[: max(limit, 0)].decode("utf-8", "ignore")


def parts(name):
    at = name.rfind(".")
    return (name[:at], name[at:]) if at > 0 else (name, "")


def candidate(name, k):
    stem, ext = parts(name)
    mark = f" ({k})"
    return cut(stem, 255 - len(mark) - len(ext.encode())) + mark + ext


def places(entries, folded=False):
    key = str.lower if folded else str
    root, out = {}, {}

    def free_name(children, name):
        k = 1
        shown = name
        while key(shown) in children:
            k += 1
            shown = candidate(name, k)
        return shown

    for track, path in sorted(entries):
        steps = [s for s in path.split("/") if s not in ("", ".", "..")]
        if not steps:
            continue
        here, shown = root, []
        for step in steps[:-1]:
            step = cut(step, 255)
            found = here.get(key(step))
            if found is None or found[1] is None:
                name = free_name(here, step)
                found = here[key(name)] = (name, {})
            shown.append(found[0])
            here = found[1]
        leaf = steps[-1]
        if len(leaf.encode()) > 255:
            stem, ext = parts(leaf)
            room = 255 - len(ext.encode())
            leaf = cut(stem, room) + ext if ext and room > 0 else cut(leaf, 255)
        name = free_name(here, leaf)
        here[key(name)] = (name, None)
        out[track] = "/".join([*shown, name])
    return out
