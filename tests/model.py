"""One-at-a-time models of the record rules, to check the batch jobs against."""

from __future__ import annotations


def apply_sequentially(mutations, live=()):
    """Accepted flags of `(seq, key, action)` rows, and the live keys at the end."""
    live = set(live)
    accepted = {}
    for seq, key, action in sorted(mutations):
        ok = (key not in live) if action == "Add" else (key in live)
        if ok and action == "Add":
            live.add(key)
        if ok and action == "Delete":
            live.remove(key)
        accepted[seq] = ok
    return accepted, live


def apply_with_templates(mutations):
    """The same for `(seq, kind, template, key, action)` rows of templates and forms.

    Returns per `seq` the accepted flag and, for forms, the generation they met.
    """
    open_since, forms, outcome = {}, {}, {}
    for seq, kind, template, key, action in sorted(mutations):
        if kind == "Template":
            ok = (template not in open_since) if action == "Add" else (template in open_since)
            if ok and action == "Delete":
                del open_since[template]
                forms.pop(template, None)
            elif ok:
                open_since[template] = seq
                forms[template] = set()
            outcome[seq] = (ok, None)
            continue
        generation = open_since.get(template)
        if generation is None:
            outcome[seq] = (False, None)
            continue
        live = forms[template]
        ok = (key not in live) if action == "Add" else (key in live)
        if ok and action == "Add":
            live.add(key)
        if ok and action == "Delete":
            live.remove(key)
        outcome[seq] = (ok, generation)
    return outcome, {(t, key) for t, keys in forms.items() for key in keys}
