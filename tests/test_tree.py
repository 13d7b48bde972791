"""A small source tree, its tables and the views over them."""

import pytest

from codelake import build
from codelake.functions import code, constants

FILES = {
    "levels/level_defines.h": 'STUB_LEVEL("", LEVEL_NONE, COURSE_NONE, 20)\nDEFINE_LEVEL("COVE (OLD)", LEVEL_COVE, COURSE_COVE, cove, gen, 1, 2, sCamCove)\n',
    "levels/course_defines.h": "DEFINE_COURSE(COURSE_COVE, 0x44440000) // (1) Deep Cove (East)\nDEFINE_BONUS_COURSE(COURSE_END, 0x0)\n",
    "levels/scripts.c": "LOAD_MODEL_FROM_GEO(MODEL_COIN, coin_geo),\n",
    "levels/cove/script.c": """static const LevelScript script_objects_1[] = {
    OBJECT(MODEL_CRAB, 1, -2, 3, 0, 90, 0, BPARAM1(0x01) | BPARAM2(WARP_NODE_0A), bhvCrab),
    RETURN(),
};
static const LevelScript script_loose[] = {
    OBJECT_WITH_ACTS(/*model*/ MODEL_CRAB, /*pos*/ 4, 5, 6, 0, 0, 0, BPARAM2(0x03), bhvCrab, ACT_1 | ACT_3),
};
const LevelScript level_entry[] = {
    LOAD_MODEL_FROM_DL(MODEL_CRAB, crab_dl, LAYER_ALPHA),
    WARP_NODE(0xF0, LEVEL_COVE, 1, 0x0B, WARP_NO_CHECKPOINT),
    AREA(2, cove_geo),
        JUMP_LINK(script_objects_1),
        OBJECT(MODEL_COIN, 7, 8, 9, 0, 0, 0, 0, bhvCoin),
        PAINTING_WARP_NODE(0x00, LEVEL_COVE, 1, 0x0A, 0),
        INSTANT_WARP(3, 1, 0, -5, 10),
        TERRAIN_TYPE(TERRAIN_SAND),
        SET_BACKGROUND_MUSIC(0, SEQ_WAVES),
    END_AREA(),
    AREA(3, open_geo),
""",
    "levels/cove/areas/2/macro.inc.c": "MACRO_OBJECT(macro_crab, 90, 1, 2, 3),\nMACRO_OBJECT_WITH_BHV_PARAM(macro_coin, 0, 4, 5, 6, 0x10),\nMACRO_OBJECT_END(),\n",
    "levels/cove/areas/2/collision.inc.c": "SPECIAL_OBJECT(special_door, 1, 2, 3),\nSPECIAL_OBJECT_WITH_YAW_AND_PARAM(special_gate, 1, 2, 3, 64, 5),\nSPECIAL_OBJECT(special_unknown, 0, 0, 0),\n",
    "include/macro_presets.h": "enum MacroPresets {\n    macro_crab,\n    macro_coin, // last\n    macro_count\n};\n",
    "include/macro_presets.inc.c": "struct MacroPreset sMacroObjectPresets[] = {\n    { bhvCrab, MODEL_CRAB, 0 }, // a\n    { bhvCoin, MODEL_COIN, COIN_KIND },\n};\n",
    "include/special_presets.h": "enum SpecialPresets {\n    special_door = 0x10,\n    special_gate = special_door,\n    special_next\n};\n",
    "include/special_presets.inc.c": "struct SpecialPreset sSpecialObjectPresets[] = {\n    { special_door, SPTYPE_YAW, 0x05, MODEL_DOOR, NULL },\n    { special_odd, SPTYPE_YAW, 1, MODEL_DOOR, bhvDoor },\n};\n",
    "include/model_ids.h": "#define MODEL_IDS_H\n#define MODEL_CRAB 0x0A // crab\n#define MODEL_COIN 11\n#define MODEL_GEM MODEL_CRAB\n#define MODEL_LOST UNKNOWN\n",
    "include/seq_ids.h": "enum SeqId {\n    SEQ_WAVES,\n    SEQ_WIND = 5,\n    SEQ_COUNT\n};\n",
    "include/sounds.h": "#define SOUND_ARG_LOAD(bank, id) ((bank) << 28)\n#define SOUND_BANK_X 1\n#define SOUND_SPLASH /* 0x30010080 */ SOUND_ARG_LOAD(SOUND_BANK_X, 0x01)\n",
    "include/object_constants.h": "#define CONSTANTS_H\n#define KIND_A 0x10\n#define KIND_B (KIND_A | 1)\n#define WARP_NODE_0A 99\n#define F(x) (x)\n#define LONG_ONE \\\n    7\n",
    "src/game/level_update.h": "enum WarpNodes {\n    WARP_NODE_0A = 0x0A,\n    WARP_NODE_DEATH = -1\n};\n",
    "include/dialog_ids.h": "enum DialogID {\n    DIALOG_NONE = -1,\n    DIALOG_000\n};\n",
    "text/us/dialogs.h": '#define BUTTON "X"\n#define BUTTON "A"\nDEFINE_DIALOG(DIALOG_000, 1, 4, 30, 200, _("Press (" BUTTON ")\\n\\\nto \\"go\\""))\n',
    "text/us/courses.h": 'COURSE_ACTS(COURSE_COVE, _(" 1 DEEP, DARK COVE"),\n    _("A"), _("B (2)"), _(""), _("D"), _("E"), _("F"))\nSECRET_STAR(COURSE_END, _("   THE END"))\nSECRET_STAR(COURSE_NONE, _(""))\nCASTLE_SECRET_STARS(_("x"))\n',
    "include/behavior_data.h": "extern const BehaviorScript bhvCrab[];\nextern const BehaviorScript bhvCoin[];\nextern const BehaviorScript bhvCrab[];\nextern const BehaviorScript bhvOnlyHere[];\n",
    "data/behavior_data.c": """const BehaviorScript bhvCrab[] = {
    BEGIN(OBJ_LIST_PUSHABLE),
    OR_INT(oFlags, (FLAG_A | (FLAG_B))),
    CALL_NATIVE(bhv_crab_loop),
    SPAWN_CHILD_WITH_PARAM(3, MODEL_COIN, bhvCoin),
};
const BehaviorScript bhvCoin[] = {
    LOAD_COLLISION_DATA(coin_collision),
    CALL_NATIVE(menu_loop),
};
""",
    "src/game/behaviors/crab.inc.c": """struct Contents sContents[] = { { 0, MODEL_GEM, bhvGem }, { 1, 0, bhvPearl } };
void (*sActs[])(void) = { NULL, crab_act_walk, crab_act_hide };
void crab_act_walk(void) { cur_obj_play_sound_2(SOUND_SPLASH); }
void crab_act_hide(void) { spawn_object(o, MODEL_COIN, bhvCoin); /* call(x) */ }
struct Object *drop(const BehaviorScript *behavior) { return spawn_object(o, sModel, behavior); }
static void helper(s32 a) {
    if (a > sins(3)) {
        drop(bhvShell);
    } else
        spawn_object(o, 0, sContents[a].behavior);
}
void bhv_crab_loop(void) {
    cur_obj_call_action_function(sActs);
    helper((s16)(1));
    foo(bar(1, 2),
        "a, b");
}
""",
    "src/menu/menu.c": "void local(void) { play_sound(SOUND_X); }\nvoid menu_loop(void) { local(); }\n",
    "src/game/camera.c": "/**\n * Near the\n * cove.\n */\nstruct CameraTrigger sCamCove[] = {\n    { 1, cam_near, 1, 2, 3, 4, 5, 6, -0x2000 },\n    NULL_TRIGGER\n};\nstruct CameraTrigger sCamDead[] = {\n    { -1, cam_far, 1, 2, 3, 4, 5, 6, 0 },\n    NULL_TRIGGER\n};\nstruct CameraTrigger *sCameraTriggers[2] = { NULL, sCamCove };\n",
}


FILES |= {
    "include/game.h": """#define ACT_FLAG_AIR /* 0x1 */ (1 << 11)
#define ACT_FLAG_SAFE (1 << 12)
#define ACT_GROUP_MASK 0x000001C0
#define ACT_GROUP_MOVING /* x */ (1 << 6)
#define ACT_NONE 0x00000000
#define ACT_RUN 0x00001041 // a
#define ACT_JUMP 0x00000842
#define ACT_HANG 0x00000043
#define ACT_SINK 0x00000044
#define ACT_LAND 0x00000045
""",
    "src/game/mario.c": """u32 set_mario_action(struct M *m, u32 action, u32 arg) { return set_mario_action_airborne(m, action, arg); }
s32 common_step(struct M *m, u32 landAction, u32 stepArg) {
    switch (perform_step(m, stepArg)) {
        case STEP_CEILING:
            set_mario_action(m, ACT_HANG, 0);
            break;
        case STEP_LANDED:
            set_mario_action(m, landAction, 0);
            break;
    }
}
""",
    "src/game/mario_actions_moving.c": """s32 act_run(struct M *m) {
#if RUMBLE
    queue(5, 80);
#endif
    if (m->input & 2) {
        return set_mario_action(m, m->fast ? ACT_JUMP : ACT_LAND, 0);
    }
    common_step(m, ACT_LAND, 0);
}
s32 act_jump(struct M *m) { common_step(m, ACT_RUN, STEP_CHECK_HANG); }
s32 check_cancels(struct M *m) {
    if (!(m->action & ACT_FLAG_SAFE)) { return set_mario_action(m, ACT_SINK, 0); }
}
s32 mario_execute_moving_action(struct M *m) {
    if (check_cancels(m)) return TRUE;
    switch (m->action) {
        case ACT_RUN: cancel = act_run(m); break;
        case ACT_HANG:
        case ACT_JUMP: cancel = act_jump(m); break;
        default: break;
    }
}
""",
    "src/game/mario_step.c": "s32 perform_step(struct M *m, u32 stepArg) {\n if (x) { if (stepArg & STEP_CHECK_HANG) { return STEP_CEILING; } }\n return STEP_LANDED;\n}\n",
}

FILES |= {
    "include/types.h": "typedef short s16;\ntypedef s16 Triple[3];\n",
    "src/game/save_file.h": """#ifndef GUARD_H
#define SIZE 0x100
struct Sign {
    u16 magic;
    u16 sum;
};
// One file.
struct File {
    u8 a;
    // Where it lies.
    Triple pos;
    u32 flags;
    u8 stars[COURSE_COUNT];
    struct Sign sign;
};
struct SaveBuffer {
    struct File files[2][2];
#ifdef VERSION_EU
    u16 language;
#else
    /* rest */
    u8 filler[SIZE - 4 * sizeof(struct File)];
#endif
};
struct Unused {
    u8 x;
};
#define SAVE_FLAG_ONE /* 0x1 */ (1 << 0)
#define SAVE_FLAG_KEY (1 << 4)
#define SAVE_FLAG_BOTH (SAVE_FLAG_ONE | SAVE_FLAG_KEY)
#define SAVE_FLAG_OF(x) ((x) >> 24)
#endif
""",
}


def rows(df, *columns, order=None):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_placements(tables):
    t = tables["object"]
    assert rows(t, "model_name", "level", "area", "initial_y", "bhv_param_value", "bhv_param_1", "bhv_param_2", "in_act_2", "in_act_3") == sorted([
        ("MODEL_CRAB", "cove", 2, -2, None, "0x01", "WARP_NODE_0A", True, True), ("MODEL_CRAB", "cove", 0, 5, 3 << 16, None, "0x03", False, True), ("MODEL_COIN", "cove", 2, 8, 0, None, None, True, True)
    ], key=repr)
    assert rows(tables["macro_object"], "macro_name", "area", "yaw", "pos_z", "bhv_param", "bhv_param_value") == [("macro_coin", 2, 0, 6, "0x10", 16), ("macro_crab", 2, 90, 3, "0", 0)]
    assert rows(tables["special_object"], "preset_name", "preset_id", "yaw", "bhv_param_value") == [("special_door", 16, 0, 0), ("special_gate", 16, 64, 5), ("special_unknown", -1, 0, 0)]
    assert rows(tables["warp"], "area", "node_id", "dest_area", "is_painting") == [(0, "0xF0", 1, False), (2, "0x00", 1, True)]
    assert rows(tables["instant_warp"], "area", "warp_index", "displace_y") == [(2, 3, -5)]
    assert rows(tables["area"], *tables["area"].columns) == [("cove", 2, "cove_geo", "TERRAIN_SAND", "SEQ_WAVES", None)]
    assert rows(tables["model_load"], *tables["model_load"].columns) == [("common", "MODEL_COIN", "coin_geo", None, "geo"), ("cove", "MODEL_CRAB", "crab_dl", "LAYER_ALPHA", "dl")]


def test_names_and_numbers(tables):
    every = lambda name: rows(tables[name], *tables[name].columns)
    assert every("macro_preset") == [("macro_coin", "bhvCoin", "MODEL_COIN", "COIN_KIND", None), ("macro_crab", "bhvCrab", "MODEL_CRAB", "0", 0)]
    assert every("special_preset") == [("special_door", 16, "SPTYPE_YAW", 5, "MODEL_DOOR", "NULL"), ("special_odd", -1, "SPTYPE_YAW", 1, "MODEL_DOOR", "bhvDoor")]
    assert every("level") == [("LEVEL_COVE", "COURSE_COVE", "cove", "COVE (OLD)", False), ("LEVEL_NONE", "COURSE_NONE", None, "", True)]
    assert every("course") == [("COURSE_COVE", "Deep Cove (East)", 0x44440000, False, 1), ("COURSE_END", "", 0, True, 2)]
    assert every("model") == [("MODEL_COIN", 11), ("MODEL_CRAB", 10), ("MODEL_GEM", 10)]
    assert every("sequence") == [("SEQ_WAVES", 0), ("SEQ_WIND", 5)] and every("mario_animation") == []
    assert every("sound") == [("SOUND_SPLASH", 0x30010080, "SOUND_BANK_X")]
    assert every("constant") == sorted([("WARP_NODE_0A", 10, "warp_nodes"), ("WARP_NODE_DEATH", -1, "warp_nodes"), ("KIND_A", 16, "object_constants"), ("KIND_B", 17, "object_constants"), ("LONG_ONE", 7, "object_constants")], key=repr)
    assert every("dialog") == [("DIALOG_000", 0, 4, 30, 200, 'Press (A)\nto "go"')]
    assert every("course_name") == [("COURSE_COVE", 1, "DEEP, DARK COVE"), ("COURSE_END", 0, "THE END")]
    assert every("star") == sorted([("COURSE_COVE", "main", i, n) for i, n in enumerate(["A", "B (2)", "", "D", "E", "F"], 1) if n] + [("COURSE_END", "secret", 0, "THE END")], key=repr)
    assert every("camera_trigger") == sorted([("cove", "sCamCove", 0, 1, "cam_near", 1, 2, 3, 4, 5, 6, -0x2000, "Near the cove.", "src/game/camera.c", 6), (None, "sCamDead", 0, -1, "cam_far", 1, 2, 3, 4, 5, 6, 0, None, "src/game/camera.c", 10)], key=repr)


def test_behaviours(tables):
    assert rows(tables["behavior"], "behavior_name", "obj_list") == [("bhvCoin", ""), ("bhvCrab", "OBJ_LIST_PUSHABLE"), ("bhvOnlyHere", "")]
    assert rows(tables["behavior_command"].filter("behavior_name = 'bhvCrab'"), "seq", "command", "args_json")[:2] == [(0, "BEGIN", '["OBJ_LIST_PUSHABLE"]'), (1, "OR_INT", '["oFlags", "(FLAG_A | (FLAG_B))"]')]
    calls = tables["behavior_call"]
    assert rows(calls.select("behavior_name", "function").distinct(), "behavior_name", "function") == sorted([("bhvCrab", f) for f in ("bhv_crab_loop", "crab_act_walk", "crab_act_hide", "drop", "helper")] + [("bhvCoin", "menu_loop")])
    assert rows(calls.filter("function = 'bhv_crab_loop'"), "seq", "call", "args", "line") == [(0, "cur_obj_call_action_function", "sActs", 13), (1, "helper", "(s16)(1)", 14), (2, "foo", 'bar(1, 2), "a, b"', 15), (3, "bar", "1, 2", 15)]
    spawns = tables["behavior_data_spawn"]
    assert rows(spawns, "behavior_name", "spawned_behavior", "spawned_model", "source", "function") == [("bhvCrab", "bhvGem", "MODEL_GEM", "sContents", "helper"), ("bhvCrab", "bhvPearl", None, "sContents", "helper"), ("bhvCrab", "bhvShell", None, "arg", "drop")]


def test_views(tables):
    views = build.views(tables)
    every = lambda name: rows(views[name], *views[name].columns)
    assert every("behavior_spawn") == [("bhvCrab", 3, "child_with_param", "MODEL_COIN", "bhvCoin", "3")]
    assert every("behavior_native") == [("bhvCoin", 1, "menu_loop"), ("bhvCrab", 2, "bhv_crab_loop")]
    assert every("behavior_resource") == [("bhvCoin", 0, "collision", "coin_collision")]
    assert rows(views["behavior_calls_spawn"], "function", "spawned_behavior", "spawned_model") == [("crab_act_hide", "bhvCoin", "MODEL_COIN")]
    assert rows(views["behavior_calls_sound"], "sound") == [("SOUND_SPLASH",)]
    assert rows(views["behavior_all_spawns"], "spawned_behavior", "origin") == [("bhvCoin", "c"), ("bhvCoin", "script"), ("bhvGem", "data"), ("bhvPearl", "data"), ("bhvShell", "data")]
    assert "helper" in [r[0] for r in every("behavior_call_unclassified")]
    assert every("camera_trigger_unused") == [("sCamDead", 1)]
    assert rows(build.orphans(tables, "object", "model_name", "model", "model_name"), "model_name") == []
    assert build.joined(tables, "warp", "dest_level").count() == 2


def test_saved_tables_answer_sql(spark, tables, tmp_path):
    some = {name: tables[name] for name in ("level", "course")}
    build.save(some, str(tmp_path))
    build.register(build.open_saved(spark, str(tmp_path), list(some)))
    assert spark.sql("select display_name from level join course using (course_name)").first()[0] == "Deep Cove (East)"


def test_action_views(spark):
    t = {
        "mario_action": spark.createDataFrame([("ACT_A",), ("ACT_B",)], "action_name string"),
        "mario_action_call": spark.createDataFrame([("ACT_A", "ACT_B", None), ("ACT_A", "ACT_B", None), ("ACT_A", "endAction", None), ("ACT_B", "ACT_A", "flag"), ("ACT_A", None, None)], "action_name string, target string, gated_by string"),
        "mario_action_data_transition": spark.createDataFrame([("ACT_B", "ACT_B"), ("ACT_A", "ACT_B")], "action_name string, to_action string"),
        "save_struct": spark.createDataFrame([("S", 10), ("E", 4)], "struct_name string, size int"),
        "save_field": spark.createDataFrame([("S", 4), ("S", 2)], "struct_name string, size int"),
    }
    views = build.views(t)
    every = lambda name: rows(views[name], *views[name].columns)
    assert every("mario_transition") == [("ACT_A", "ACT_B")]
    assert every("mario_transition_refuted") == [("ACT_B", "ACT_A", "flag")]
    assert every("mario_action_call_unclassified") == [("endAction", 1)]
    assert every("mario_all_transitions") == [("ACT_A", "ACT_B"), ("ACT_B", "ACT_B")]
    assert every("save_struct_coverage") == [("E", 4, 0, 4), ("S", 10, 6, 4)]


def test_state_machine(tables):
    every = lambda name, *c: rows(tables[name], *(c or tables[name].columns))
    nodes = {r[0]: r[1:] for r in every("mario_action")}
    moving, src = "MOVING", "src/game/mario_actions_moving.c"
    assert nodes["ACT_RUN"] == ("0x00001041", moving, '["SAFE"]', "act_run", src, 1)
    assert nodes["ACT_JUMP"][:4] == ("0x00000842", moving, '["AIR"]', "act_jump") and nodes["ACT_HANG"][3] == "act_jump"
    assert nodes["ACT_NONE"] == ("0x00000000", None, "[]", None, None, None) and len(nodes) == 6
    assert every("mario_action_call", "action_name", "function", "target", "condition", "gated_by") == sorted([
        ("ACT_RUN", "act_run", "m->fast ? ACT_JUMP : ACT_LAND", "m->input & 2", None),
        *((a, "common_step", "landAction", None, None) for a in ("ACT_RUN", "ACT_JUMP", "ACT_HANG")),
        ("ACT_RUN", "common_step", "ACT_HANG", None, "STEP_CHECK_HANG"), ("ACT_JUMP", "common_step", "ACT_HANG", None, None), ("ACT_HANG", "common_step", "ACT_HANG", None, None),
        ("ACT_RUN", "check_cancels", "ACT_SINK", "!(m->action & ACT_FLAG_SAFE)", "!(ACT_FLAG_SAFE)"),
        *((a, "check_cancels", "ACT_SINK", "!(m->action & ACT_FLAG_SAFE)", None) for a in ("ACT_JUMP", "ACT_HANG")),
    ], key=repr)
    assert every("mario_action_data_transition", "action_name", "to_action", "source", "function") == sorted([
        ("ACT_RUN", "ACT_JUMP", "expr", "act_run"), ("ACT_RUN", "ACT_LAND", "expr", "act_run"), ("ACT_JUMP", "ACT_RUN", "landAction", "act_jump"), ("ACT_HANG", "ACT_RUN", "landAction", "act_jump")
    ], key=repr)
    views = build.views(tables)
    assert rows(views["mario_transition_refuted"], "action_name", "to_action") == [("ACT_RUN", "ACT_HANG"), ("ACT_RUN", "ACT_SINK")]
    assert views["mario_all_transitions"].count() == 8


def test_save_layout(tables):
    every = lambda name, *c: rows(tables[name], *(c or tables[name].columns))
    assert every("save_struct") == [("File", 20, 4, "One file."), ("SaveBuffer", 256, 4, None), ("Sign", 4, 2, None)]
    fields = {r[0]: r[1:] for r in rows(tables["save_field"].filter("struct_name <> 'Sign'"), "field_name", "offset", "size", "dims", "is_struct", "doc")}
    assert fields["pos"] == (2, 6, "", False, "Where it lies.") and fields["flags"] == (8, 4, "", False, None) and fields["stars"] == (12, 1, "1", False, None)
    assert fields["sign"] == (14, 4, "", True, None) and fields["files"] == (0, 80, "2,2", True, None) and fields["filler"] == (80, 176, "176", False, "rest")
    assert every("save_flag") == [("flags", 0, "SAVE_FLAG_ONE", 1), ("flags", 4, "SAVE_FLAG_KEY", 16)]
    assert rows(build.views(tables)["save_struct_coverage"], "struct_name", "padding_bytes") == [("File", 20 - (1 + 6 + 4 + 1 + 4)), ("SaveBuffer", 0), ("Sign", 0)]


def test_expressions():
    given = {"1 | 0x10": 17, "-7 / 2": -4, "~1 & 6": 6, "(3 << 2) % 5": 2, "BPARAM1(1) | BPARAM4(300)": (1 << 24) | 44, "010": None, "A + 1": None, "'x'": None, "1 / 0": None, "1 <<": None}
    assert {k: constants.evaluate(k) for k in given} == given


def test_guards_of_calls():
    text = "int f(int a, struct X *m) {\n#if X\n if (a == 1 && g(a)) { h(\"}\"); if (a) k(); else { l(); } }\n else m->n(1);\n return a > q(a.r(1));\n}"
    [(name, line, params, calls, returns, _, _)] = code.functions(text)
    assert (name, line, params) == ("f", 1, ["a", "m"])
    assert [(c[1], c[4]) for c in calls] == [("g", "a == 1 && g(a)"), ("h", "a == 1 && g(a)"), ("k", "a"), ("l", "!(a)"), ("q", None)]
    assert [r[0] for r in returns] == ["a > q(a.r(1))"]
