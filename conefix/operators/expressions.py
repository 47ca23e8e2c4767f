"""Nested expressions flattened to steps of one operation each, as tables, for all statements at once.

``tree(fn, stmt, node, parent, ord, form, value)`` has a row for each part of an expression; ``ord`` counts
the children of a parent from 0. Forms: ``literal`` and ``name``, whose value is their text; ``binary unary cast
instanceof call new field cell array items``, which compute one value of those of their children, ``value`` being
the operator, type, method or field; ``comma``, the last of its children; ``assign``, whose value is the operator of a
compound one, of a target and a value; ``before`` and ``after``, which add (``+``) or take (``-``) one from their target. Targets are
names, fields (of an object) and cells (of an array and an index). Conditional forms are branches of statements.

``steps(fn, stmt, k, part, target, form, value, args)``, in the order (k, part), which is Java's from left to right:
``target = form value (args)``. What a part computes is the variable ``$k``; a step without a target stores, the
last argument into the field or cell that the others name. A name that an assignment could change between the place
where it stands and the step that uses it is held in a variable of its own.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conefix.operators import graph
from conefix.session import Scratch, shuffled

VALUES = ("binary", "unary", "cast", "instanceof", "call", "new", "field", "cell", "array", "items")
CHANGES = ("assign", "before", "after")
TARGETS = ("name", "field", "cell")
FORMS = ("literal", "name", "comma", *VALUES, *CHANGES)
_LAST = 2**31 - 1


def ordered(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """Parts with ``k``, their place in the order of evaluation, and ``above``, the parts around them."""
    nodes = scratch.save(tree.select("fn", "stmt", "node", "parent", F.col("ord").cast("int").alias("ord"), "form", "value"), "nodes")
    none = F.array().cast("array<string>")
    parts = [scratch.save(nodes.where("parent IS NULL").withColumns({"place": F.array(F.lit(0)), "above": none}), "depth-0")]
    below = nodes.where("parent IS NOT NULL")
    for depth in itertools.count(1):
        up = parts[-1].select("fn", "stmt", F.col("node").alias("parent"), F.col("place").alias("p"), F.col("above").alias("a"))
        step = below.join(up, ["fn", "stmt", "parent"]).withColumns({"place": F.concat("p", F.array("ord")), "above": F.concat("a", F.array("parent"))})
        newest = scratch.save(step.select(parts[0].columns), f"depth-{depth}")
        if newest.isEmpty():
            break
        parts.append(newest)
    # One statement's parts are a group. Children come before what they are part of.
    order = Window.partitionBy("fn", "stmt").orderBy(F.concat("place", F.array(F.lit(_LAST))))
    return graph.rows_of(iter(parts)).withColumn("k", F.row_number().over(order)).drop("place")


def _operands(parts: DataFrame) -> DataFrame:
    """``parts`` with what their users name them by, and whether a name is held for them."""
    keys = ["fn", "stmt"]
    changing = parts.where(F.col("form").isin(*CHANGES)).select(*keys, F.explode(F.concat("above", F.array("node"))).alias("node"))
    # The last child of each part within which something changes.
    last = shuffled(parts.join(changing.distinct(), [*keys, "node"], "left_semi").where("parent IS NOT NULL").groupBy(*keys, "parent").agg(F.max("ord").alias("changed")))
    up = parts.select(*keys, F.col("node").alias("parent"), F.col("form").alias("around"), F.col("value").alias("with"), F.col("ord").alias("up_ord"), F.col("parent").alias("beyond"))
    out = parts.join(up, [*keys, "parent"], "left").join(last, [*keys, "parent"], "left")
    out = out.join(last.withColumnsRenamed({"parent": "beyond", "changed": "changed_beyond"}), [*keys, "beyond"], "left")
    far = parts.where(F.col("form").isin(*CHANGES)).select(*keys, F.col("node").alias("beyond"), F.lit(True).alias("of_target"))
    out = out.join(far, [*keys, "beyond"], "left")
    is_target = F.coalesce(F.col("around").isin(*CHANGES) & (F.col("ord") == 0), F.lit(False))
    plain = is_target & (F.col("around") == "assign") & F.col("with").isNull()
    # The object or index of a target is used by the store, after the value.
    later = F.coalesce(F.col("changed") > F.col("ord"), F.lit(False)) | F.coalesce(F.col("of_target") & (F.col("up_ord") == 0) & (F.col("changed_beyond") > 0), F.lit(False))
    held = (F.col("form") == "name") & later & ~plain
    mine = F.concat(F.lit("$"), F.col("k").cast("string"))
    operand = F.when((F.col("form") == "literal") | (F.col("form") == "name") & ~held, F.col("value")).otherwise(mine)
    return out.withColumns({"held": held, "plain": plain, "is_target": is_target, "mine": mine}).withColumn("operand", operand).drop("around", "with", "up_ord", "beyond", "changed", "changed_beyond", "of_target")


def _step(part: int, target: Column, form: str | Column, value: Column, args: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), target.alias("target"), (F.lit(form) if isinstance(form, str) else form).alias("form"), value.alias("value"), args.alias("args"))


def _steps_of() -> Column:
    form, value, args, mine, none = F.col("form"), F.col("value"), F.col("args"), F.col("mine"), F.lit(None).cast("string")
    copy = lambda part, target, what: _step(part, target, "copy", none, F.array(what))
    to_name = F.col("t_form") == "name"

    def store(part: int, what: Column) -> Column:
        target, kind = F.when(to_name, F.col("t_value")), F.when(to_name, "copy").otherwise(F.concat(F.lit("store_"), "t_form"))
        return _step(part, target, kind, F.when(F.col("t_form") == "field", F.col("t_value")), F.when(to_name, F.array(what)).otherwise(F.concat("t_args", F.array(what))))

    one, more = F.lit("1"), F.concat(mine, F.lit("+"))
    old, new = args[0], F.when(F.size(args) > 1, F.element_at(args, -1))
    out = F.when((form == "name") & F.col("held"), F.array(copy(0, mine, value)))
    out = out.when(form.isin(*VALUES) & ~F.col("plain"), F.array(_step(0, mine, form, value, args)))
    out = out.when(form == "comma", F.array(copy(0, mine, F.element_at(args, -1))))
    out = out.when((form == "assign") & value.isNull(), F.array(copy(0, mine, new), store(1, mine)))
    out = out.when(form == "assign", F.array(_step(0, mine, "binary", value, F.array(old, new)), store(1, mine)))
    out = out.when(form == "before", F.array(_step(0, mine, "binary", value, F.array(old, one)), store(1, mine)))
    return out.when(form == "after", F.array(copy(0, mine, old), _step(1, more, "binary", value, F.array(mine, one)), store(2, more)))


def flatten(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``steps`` and ``errors(fn, stmt, node, form, problem)``: unknown forms, and what cannot be assigned to.

    Statements with an error have no steps.
    """
    scratch = Scratch(tree.sparkSession, "expressions", spread=True)
    keys = ["fn", "stmt"]
    parts = scratch.save(_operands(scratch.save(ordered(tree, scratch), "ordered")), "operands")
    problem = F.when(~F.col("form").isin(*FORMS), "unsupported").when(F.col("is_target") & ~F.col("form").isin(*TARGETS), "no target")
    errors = scratch.save(parts.select(*keys, "node", "form", problem.alias("problem")).where("problem IS NOT NULL"), "errors")
    sound = shuffled(parts.join(errors.select(*keys).distinct(), keys, "left_anti"))
    args = sound.where("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("node")).agg(F.sort_array(F.collect_list(F.struct("ord", "operand")))["operand"].alias("args"))
    sound = scratch.save(sound.join(args, [*keys, "node"], "left").withColumn("args", F.coalesce("args", F.array().cast("array<string>"))), "sound")
    targets = sound.where("is_target").select(*keys, F.col("parent").alias("node"), F.col("form").alias("t_form"), F.col("value").alias("t_value"), F.col("args").alias("t_args"))
    steps = sound.join(targets, [*keys, "node"], "left").select(*keys, "k", F.inline(_steps_of()))
    return steps.select(*keys, "k", "part", "target", "form", "value", "args"), errors
