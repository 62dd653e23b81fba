"""Text expressions: normalisation, categories, keyword topics, polarity, similarity."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizerModel, StopWordsRemover, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category families in order of priority, the raw categories of each, keywords of names, topics and polarity.
FAMILY_PRIORITY = (
    "sushi", "pizza", "burger", "bbq", "steakhouse", "seafood", "mexican", "italian", "chinese", "asian", "american",
    "breakfast", "fast_food", "bakery", "dessert", "ice_cream", "coffee", "cafe", "wine_bar", "brewery", "pub", "bar",
    "nightclub", "restaurant",
)
FAMILIES = {
    "restaurant": ["restaurant", "meal_takeaway", "meal_delivery", "food", "establishment", "mediterranean_restaurant",
        "middle_eastern_restaurant", "greek_restaurant", "french_restaurant", "spanish_restaurant", "latin_american_restaurant",
        "caribbean_restaurant", "african_restaurant", "ethiopian_restaurant", "vegan_restaurant", "vegetarian_restaurant",
        "gluten-free_restaurant", "organic_restaurant", "health_food_restaurant", "salad_shop", "buffet_restaurant", "caterer"],
    "cafe": ["cafe"],
    "coffee": ["coffee_shop", "coffee", "espresso_bar"],
    "bar": ["bar", "sports_bar", "cocktail_bar"],
    "nightclub": ["night_club", "nightclub"],
    "pub": ["pub"],
    "wine_bar": ["wine_bar"],
    "brewery": ["brewery", "taproom"],
    "bakery": ["bakery"],
    "ice_cream": ["ice_cream_shop", "ice_cream", "frozen_yogurt_shop"],
    "dessert": ["dessert_shop", "dessert", "candy_store", "chocolate_shop", "donut_shop"],
    "fast_food": ["fast_food_restaurant", "fast_food", "sandwich_shop", "deli"],
    "pizza": ["pizza_restaurant", "pizza", "pizzeria"],
    "burger": ["hamburger_restaurant", "burger", "burger_restaurant"],
    "breakfast": ["breakfast_restaurant", "brunch_restaurant", "breakfast", "brunch"],
    "bbq": ["barbecue_restaurant", "bbq"],
    "steakhouse": ["grill", "steakhouse", "steak_house"],
    "seafood": ["seafood_restaurant", "seafood", "fish_restaurant"],
    "sushi": ["sushi_restaurant", "sushi", "japanese_restaurant"],
    "american": ["american_restaurant", "new_american_restaurant", "southern_restaurant", "soul_food_restaurant"],
    "mexican": ["mexican_restaurant", "mexican", "tex-mex_restaurant", "taco_restaurant", "burrito_restaurant"],
    "italian": ["italian_restaurant", "italian", "pasta_restaurant"],
    "chinese": ["chinese_restaurant", "chinese", "dim_sum_restaurant"],
    "asian": ["asian_restaurant", "thai_restaurant", "vietnamese_restaurant", "korean_restaurant", "indian_restaurant",
        "asian_fusion_restaurant", "ramen_restaurant", "pho_restaurant", "noodle_restaurant"],
}
NAME_KEYWORDS = {
    "pizza": ["pizza", "pizzeria", "pie", "pizza hut", "domino", "papa john", "little caesar"],
    "burger": ["burger", "burgers", "five guys", "shake shack", "smashburger", "whataburger", "in-n-out"],
    "chinese": ["chinese", "china", "wok", "panda express", "dim sum", "szechuan", "hunan"],
    "mexican": ["mexican", "taco", "burrito", "chipotle", "qdoba", "taqueria", "cantina", "tortilla"],
    "italian": ["italian", "pasta", "trattoria", "ristorante", "olive garden", "spaghetti"],
    "sushi": ["sushi", "ramen", "hibachi", "teriyaki", "japanese"],
    "bbq": ["bbq", "barbecue", "barbeque", "smokehouse", "grill house", "pit"],
    "steakhouse": ["steakhouse", "steak house", "chophouse", "chop house", "longhorn", "outback"],
    "seafood": ["seafood", "fish", "lobster", "crab", "oyster", "shrimp", "red lobster"],
    "breakfast": ["breakfast", "pancake", "waffle", "ihop", "denny", "cracker barrel"],
    "cafe": ["cafe", "coffee", "espresso", "starbucks", "dunkin"],
    "bakery": ["bakery", "bakehouse", "bread", "pastry", "donut", "doughnut", "krispy kreme"],
    "ice_cream": ["ice cream", "gelato", "frozen yogurt", "froyo", "baskin", "cold stone"],
    "dessert": ["dessert", "sweet", "cupcake", "cookie", "cake"],
    "bar": ["bar", "pub", "tavern", "lounge", "sports bar", "grill"],
    "fast_food": ["fast food", "drive thru", "drive-thru", "quick service"],
    "american": ["diner", "grill", "american", "wings", "chicken"],
    "asian": ["asian", "thai", "vietnamese", "pho", "korean", "noodle"],
    "indian": ["indian", "curry", "tandoor"],
    "mediterranean": ["mediterranean", "greek", "gyro", "kebab", "falafel"],
}
TOPICS = {
    "dessert": ["dessert", "sweet", "cake", "ice cream", "pie", "cookie", "chocolate", "candy", "sugar"],
    "drinks": ["drink", "cocktail", "wine", "beer", "coffee", "tea", "juice", "soda", "alcohol", "beverage"],
    "service": ["service", "waiter", "waitress", "staff", "server", "friendly", "rude", "slow", "fast", "attentive"],
    "atmosphere": ["atmosphere", "ambiance", "ambience", "decor", "vibe", "cozy", "romantic", "loud", "quiet", "music"],
    "price": ["price", "expensive", "cheap", "affordable", "cost", "value", "money", "budget", "pricey", "deal"],
}
POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "perfect", "awesome", "fantastic"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "worst", "horrible", "disgusting", "poor"]


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_word(c: Column, word: str) -> Column:
    """Whether the lower-cased text contains the literal; false for null."""
    return F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))


def price_bucket(c: Column) -> Column:
    """Length of the trimmed price sign: '$$' is 2, an empty text 0, null null."""
    return F.char_length(strip(c))


def category_family(c: Column) -> Column:
    """The family of a raw category: lower case, trimmed, spaces as underscores; 'other' if unknown or null."""
    table = F.create_map(*[F.lit(x) for family, raw in FAMILIES.items() for key in raw for x in (key, family)])
    key = F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(table, key), F.lit("other"))


def category_families(raw: Column) -> Column:
    """Families of a list, each once, in the order of their first places; an empty list for null."""
    known = F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.array_distinct(F.transform(known, category_family))


def main_family(families: Column) -> Column:
    """The family of highest priority; null if there is none (then the place serves no food)."""
    order = F.array(*[F.lit(x) for x in FAMILY_PRIORITY])
    return F.get(F.filter(order, lambda x: F.array_contains(families, x)), F.lit(0))


def first_keyword_group(c: Column, groups: dict[str, list[str]] = NAME_KEYWORDS, default: str = "other") -> Column:
    """The first group one of whose keywords the lower-cased text contains."""
    low, out = F.lower(c), None
    for name, words in groups.items():
        found = any_of(low, words)
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return out.otherwise(F.lit(default))


def any_of(lowered: Column, words: list[str]) -> Column:
    """Whether the text contains one of the literals."""
    return lowered.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def topic_flags(c: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """A struct of booleans, null for a null text, so that means leave it out."""
    low = F.lower(c)
    return F.struct(*[any_of(low, words).alias(name) for name, words in topics.items()])


def polarity(c: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """(p - n) / (p + n) over the distinct keywords present; 0 if there are none, null for a null text."""
    low = F.lower(c)

    def present(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.contains(low, F.lit(w)).cast("int")
        return total

    p, n = present(positive), present(negative)
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 if neither has any."""
    x, y = (F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def _words(df: DataFrame, column: str, out: str) -> DataFrame:
    """The frame with the lower-cased words of a text but for stop words; null is an empty text."""
    split = Tokenizer(inputCol="_text", outputCol="_split").transform(df.withColumn("_text", F.coalesce(column, F.lit(""))))
    return StopWordsRemover(inputCol="_split", outputCol=out).transform(split).drop("_text", "_split")


def tfidf_cosine(df: DataFrame, left: str, right: str, features: int = 100) -> DataFrame:
    """The rows with tfidf_cosine: cosine of both texts' TF-IDF vectors over the most frequent words of all texts, the least of equally
    frequent ones. Both texts stay in their row: nothing is numbered or joined again."""
    sides, out = ("_l", "_r"), "_counts"
    rows = _words(_words(df, left, "_l"), right, "_r")
    counts = rows.select(F.explode(F.concat(*sides)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = [r.w for r in counts.orderBy(F.desc("n"), "w").limit(features).collect()]
    if not top:
        return df.withColumn("tfidf_cosine", F.lit(0.0))
    each = [CountVectorizerModel.from_vocabulary(top, c, f"{c}{out}") for c in sides]
    texts = [m.transform(rows.select(c)).select(F.col(f"{c}{out}").alias(out)) for m, c in zip(each, sides, strict=True)]
    weights = F.array(*[F.lit(float(w)) for w in IDF(inputCol=out, outputCol="_idf").fit(texts[0].unionByName(texts[1])).idf])
    for m, c in zip(each, sides, strict=True):
        rows = m.transform(rows).withColumn(c, F.zip_with(vector_to_array(f"{c}{out}"), weights, lambda n, w: n * w)).drop(f"{c}{out}")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot("_l", "_l") * dot("_r", "_r"))
    return rows.withColumn("tfidf_cosine", F.when(norm == 0, F.lit(0.0)).otherwise(dot("_l", "_r") / norm)).drop("_l", "_r")
