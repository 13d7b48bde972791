"""The gallery's questions against plain Python over rows made at random, and over the small source tree."""

import json
import random
from collections import Counter, defaultdict

import pytest

from codelake import build
from codelake.plans import gallery

LEVELS, BEHAVIORS, ACTIONS = ["cove", "hill", "moor"], [f"bhv{c}" for c in "ABCDE"], [f"ACT_{c}" for c in "RSTUVW"]
CALLS = {"spawn": "spawned_behavior", "sound": "sound", "model": "model", "dialog": "dialog", "morph": "becomes_behavior", "seek": "target_behavior"}


def made(seed):
    """Small tables as lists of dicts."""
    rng = random.Random(seed)
    some = lambda n, **kinds: [{k: f() for k, f in kinds.items()} for _ in range(n)]
    of = lambda values, null=0.0: lambda: None if rng.random() < null else rng.choice(values)
    level, area, zero, dialogs = of(LEVELS), of([1, 2]), lambda: 0, [f"DIALOG_00{i}" for i in range(6)]
    place = lambda p: {f"{p}_{a}": zero for a in "xyz"}
    t = {
        "object": some(30, level=level, area=area, behavior=of(BEHAVIORS), model_name=of(["M", "N"]), bhv_param=of(dialogs[:2] + ["0"]), **place("initial"), **{f"in_act_{i}": of([True, False]) for i in range(1, 7)}),
        "macro_object": some(15, level=level, area=area, macro_name=of(["m1", "m2", "m3", "m9"]), bhv_param=of(["1", dialogs[2]], 0.5), **place("pos")),
        "macro_preset": [dict(macro_name=f"m{i}", behavior=rng.choice(BEHAVIORS[:2]), model_name="M", param="0") for i in range(1, 7)],
        "special_object": some(8, level=level, area=area, preset_id=of([1, 2]), preset_name=of(["s1", "s2"]), **place("pos")),
        "special_preset": [dict(preset_id=i, preset_name=f"s{i}", behavior="bhvE", model_name="N") for i in (1, 2)],
        "behavior": [dict(behavior_name=b, obj_list="L" + b[-1]) for b in BEHAVIORS], "behavior_native": some(6, behavior_name=of(BEHAVIORS), func=of(["f", "g"])),
        "behavior_all_spawns": some(5, behavior_name=of(BEHAVIORS), spawned_behavior=of(BEHAVIORS, 0.1)), "dialog": [dict(dialog_name=d, text=" two  words\n" * i) for i, d in enumerate(dialogs)],
        "area": some(6, level=level, dialog=of(dialogs[3:4], 0.5), background_music=of(["one", "two", "three"], 0.2)), "level": [dict(level_name=f"LEVEL_{x.upper()}", folder=x) for x in LEVELS],
        "warp": some(6, level=level, dest_level=of([f"LEVEL_{x.upper()}" for x in LEVELS])), "mario_all_transitions": some(7, action_name=of(ACTIONS), to_action=of(ACTIONS)),
        "mario_action": [dict(action_name=a, flags_json=json.dumps(rng.sample(["X", "Y", "Z"], rng.randrange(4)))) for a in ACTIONS],
        "save_struct": [dict(struct_name="S", size=32), dict(struct_name="E", size=4)], "save_field": [dict(struct_name="S", field_name=f, offset=o, size=s) for f, o, s in (("b", 8, 8), ("a", 0, 5), ("c", 16, 10))],
    }
    return t | {f"behavior_calls_{k}": some(5, behavior_name=of(BEHAVIORS), **{v: of(dialogs[4:5] if k == "dialog" else ["p", "q"])}) for k, v in CALLS.items()}


@pytest.fixture(scope="module", params=[3, 4])
def both(spark, request):
    plain = made(request.param)
    frames = {k: spark.createDataFrame([tuple(r.values()) for r in v], ", ".join(f"{c} {kind(v, c)}" for c in v[0])) for k, v in plain.items()}
    return plain, frames


def kind(rows, column):
    return {bool: "boolean", int: "int"}.get(type(next((r[column] for r in rows if r[column] is not None), "")), "string")


def placed(p, named=False):
    macros, specials = {r["macro_name"]: r["behavior"] for r in p["macro_preset"]}, {r["preset_name" if named else "preset_id"]: r["behavior"] for r in p["special_preset"]}
    rows = [("object", r["level"], r["area"], r["behavior"]) for r in p["object"]]
    rows += [("macro", r["level"], r["area"], macros.get(r["macro_name"])) for r in p["macro_object"] if not named or r["macro_name"] in macros]
    return rows + [("special", r["level"], r["area"], specials.get(r["preset_name" if named else "preset_id"])) for r in p["special_object"]]


def got(both, name, *values):
    rows = gallery.QUESTIONS[name](both[1], *values).collect()
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


def test_crowding_and_acts(both):
    p = both[0]
    n, levels, kinds = Counter((x, a) for _, x, a, _ in placed(p)), Counter(x for _, x, _, _ in placed(p)), defaultdict(set)
    for k, x, a, _ in placed(p):
        kinds[x, a].add(k)
    assert got(both, "crowding", 9) == sorted(((x, a, k, k / levels[x], tuple(sorted(kinds[x, a]))) for (x, a), k in n.items() if k >= 9), key=repr)
    acts = [(r["level"], [i for i in range(1, 7) if r[f"in_act_{i}"]]) for r in p["object"]]
    shown, alone = Counter((x, i) for x, a in acts for i in a), Counter((x, a[0]) for x, a in acts if len(a) == 1)
    assert got(both, "acts_shown") == sorted(((x, i, k, alone[x, i]) for (x, i), k in shown.items()), key=repr)


def test_progeny(both):
    edges = {(r["behavior_name"], r["spawned_behavior"]) for r in both[0]["behavior_all_spawns"] if r["spawned_behavior"]}
    for b in BEHAVIORS[:3]:
        found, last = {b}, None
        while found != last:
            last, found = found, found | {y for x, y in edges if x in found}
        assert got(both, "progeny", b) == sorted(((x, (b, x) in edges, "L" + x[-1]) for x in found - {b}), key=repr)


def test_roles_and_mute(both):
    p = both[0]
    counts = {f"{k}s": Counter(r["behavior_name"] for r in p[f"behavior_calls_{k}"]) for k in CALLS} | {"placed": Counter(b for *_, b in placed(p, True) if b)}
    assert got(both, "roles") == sorted(((b, *(c[b] for c in counts.values())) for b in set().union(*counts.values())), key=repr)
    loud = set(counts["sounds"]) | set(counts["dialogs"])
    assert got(both, "mute") == sorted(((b, counts["placed"][b]) for b in {r["behavior_name"] for r in p["behavior_native"]} - loud if counts["placed"][b]), key=repr)


def test_names_that_nothing_uses(both):
    p = both[0]
    used = {r["dialog"] for r in p["behavior_calls_dialog"] + p["area"]} | {r["bhv_param"] for r in p["object"] + p["macro_object"]}
    assert got(both, "unheard_dialogs") == sorted(((r["dialog_name"], len(r["text"].split())) for r in p["dialog"] if r["dialog_name"] not in used), key=repr)
    ways = Counter((f"LEVEL_{r['level'].upper()}", r["dest_level"]) for r in p["warp"])
    assert got(both, "one_way_warps") == sorted(((a, b, n) for (a, b), n in ways.items() if a != b and not ways[b, a]), key=repr)
    twins = defaultdict(set)
    for r in p["macro_preset"]:
        twins[r["behavior"], r["model_name"]].add(r["macro_name"])
    assert got(both, "twin_presets") == sorted(((*k, tuple(sorted(v))) for k, v in twins.items() if len(v) > 1), key=repr)
    music = defaultdict(set)
    for r in p["area"]:
        music[r["background_music"]].add(r["level"])
    assert got(both, "shared_music") == sorted(((m, tuple(sorted(v))) for m, v in music.items() if m and len(v) > 1), key=repr)


def test_actions_and_holes(both):
    p = both[0]
    ways = {(r["action_name"], r["to_action"]) for r in p["mario_all_transitions"] if r["action_name"] != r["to_action"]}
    assert got(both, "dead_ends") == sorted(((b, len({x for x, y in ways if y == b})) for b in {y for _, y in ways} - {x for x, _ in ways}), key=repr)
    sets = [set(json.loads(r["flags_json"])) for r in p["mario_action"]]
    own = [s for s in sets if "X" in s]
    want = Counter(f for s in own for f in s - {"X"})
    assert got(both, "flag_company", "X") == sorted(((f, n, n / len(own)) for f, n in want.items()), key=repr)
    assert got(both, "holes") == [("S", "a", 5, 3), ("S", "c", 26, 6)]


def test_own_texts_bind_their_values(spark):
    text = "SELECT :who AS who, count(*) AS n FROM range(10) WHERE id < :most"
    assert [tuple(r) for r in gallery.ask(spark, text, who="O'Hara; --", most=3).collect()] == [("O'Hara; --", 3)]
    with pytest.raises(ValueError, match="no parameter"):
        gallery.ask(spark, text, who="x", most=1, least=0)


def test_every_question_on_the_small_tree(tables):
    t = tables | build.views(tables)
    values = {"progeny": ("bhvCrab",), "flag_company": ("ATTACKING",)}
    for name, plan in gallery.QUESTIONS.items():
        assert plan(t, *values.get(name, ())).columns
    assert {r["descendant"] for r in gallery.progeny(t, "bhvCrab").collect()} == {"bhvCoin", "bhvGem", "bhvPearl", "bhvShell"}
