"""Operations on a class-probability array (index = class id)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.labels import label_name
from flowspark.schema import ATTACK_GATE, N_CLASSES


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside the lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    def shifted(v):
        return F.struct(v.alias("v"), F.array_max(v).alias("top"))

    def powered(s):
        return F.transform(s["v"], lambda x: F.exp(x - s["top"]))

    def totalled(p):
        return F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total"))

    def shared(s):
        return F.transform(s["p"], lambda x: x / s["total"])

    return let(let(let(let(logits, shifted), powered), totalled), shared)


def argmax_class(probs: Column) -> Column:
    """First class with the highest value."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column, class_id: Column) -> Column:
    """Probability of a class, 0 when the class is outside the array."""
    inside = (class_id >= 0) & (class_id < F.size(probs))
    return F.when(inside, F.get(probs, class_id.cast("int"))).otherwise(F.lit(0.0))


def attack_score(probs: Column) -> Column:
    """1 - P(benign)."""
    return F.lit(1.0) - F.get(probs, F.lit(0))


def gated_class(probs: Column, class_id: Column, threshold=ATTACK_GATE) -> Column:
    """Class after the attack gate: benign unless 1 - P(benign) reaches the threshold."""
    return F.when(attack_score(probs) < threshold, F.lit(0)).otherwise(class_id).cast("int")


def gated_confidence(probs: Column, class_id: Column, threshold=ATTACK_GATE) -> Column:
    return F.when(attack_score(probs) < threshold, F.get(probs, F.lit(0))).otherwise(confidence(probs, class_id))


def scatter_classes(probs: Column, classes, n_classes=N_CLASSES) -> Column:
    """Spread probabilities of the trained classes (ascending ids) over all class slots."""
    position = {c: i for i, c in enumerate(classes)}
    return F.array(*[
        F.get(probs, F.lit(position[c])) if c in position else F.lit(0.0) for c in range(n_classes)
    ])


def decode_class(index: Column, classes) -> Column:
    """Class id of a trained-class index."""
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def top_predictions(probs: Column, n=3, digits=4) -> Column:
    """The n most probable classes as structs, ties by id."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("id"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: F.struct(
        r["id"].alias("attack_id"),
        label_name(r["id"]).alias("attack_name"),
        F.round(-r["neg"], digits).alias("probability"),
    ))


def top_probability_map(probs: Column, n=5, digits=4) -> Column:
    return F.map_from_entries(F.transform(
        top_predictions(probs, n, digits), lambda r: F.struct(r["attack_name"], r["probability"])
    ))


def truncate_vector(vector: Column, dims) -> Column:
    """First dims entries; not normalised again."""
    return F.slice(vector, 1, dims)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm).otherwise(F.lit(1.0))


def attention_entropy(weights: Column) -> Column:
    """Natural-log entropy of an array of weights."""
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s - w * F.ln(w + F.lit(1e-10)))
