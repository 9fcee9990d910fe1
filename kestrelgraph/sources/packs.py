"""Built-in packs of facts to start a graph with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgraph.functions.text import normalize

# The packs' triples.
PACKS = {
    "animals": """
dogs, is, mammals
cats, is, mammals
birds, is, animals
fish, is, animals
mammals, is, animals
reptiles, is, animals
insects, is, animals
dogs, has, four legs
dogs, has, fur
dogs, has, a tail
cats, has, four legs
cats, has, fur
cats, has, whiskers
birds, has, wings
birds, has, feathers
birds, has, a beak
fish, has, fins
fish, has, gills
fish, has, scales
dogs, can, bark
dogs, can, run
dogs, can, swim
cats, can, meow
cats, can, climb
cats, can, hunt
birds, can, fly
birds, can, sing
fish, can, swim
fish, lives_in, water
birds, lives_in, nests
bears, lives_in, forests
penguins, lives_in, antarctica
camels, lives_in, deserts
cats, eats, fish
cats, eats, mice
dogs, eats, meat
birds, eats, seeds
birds, eats, worms
cows, eats, grass
lions, eats, meat
lions, is, mammals
lions, is, predators
elephants, is, mammals
elephants, has, trunk
elephants, has, tusks
whales, is, mammals
whales, lives_in, ocean
dolphins, is, mammals
dolphins, can, swim
dolphins, is, intelligent
""",
    "nature": """
rain, causes, floods
rain, causes, wet ground
sun, causes, heat
sun, causes, light
wind, causes, waves
cold, causes, ice
heat, causes, evaporation
evaporation, causes, clouds
clouds, causes, rain
trees, has, leaves
trees, has, roots
trees, has, branches
trees, needs, water
trees, needs, sunlight
plants, needs, water
plants, needs, sunlight
flowers, has, petals
flowers, is, plants
sky, color, blue
grass, color, green
sun, color, yellow
snow, color, white
roses, color, red
leaves, color, green
ocean, contains, salt water
rivers, contains, fresh water
lakes, contains, fresh water
rain, is, water
snow, is, frozen water
ice, is, frozen water
""",
    "science": """
gravity, causes, falling
heat, causes, expansion
cold, causes, contraction
friction, causes, heat
light, is, energy
sound, is, vibration
earth, is, planet
mars, is, planet
jupiter, is, planet
sun, is, star
moon, is, satellite
earth, has, moon
jupiter, has, moons
water, is, liquid
ice, is, solid
steam, is, gas
oxygen, is, gas
iron, is, metal
gold, is, metal
humans, is, mammals
humans, needs, oxygen
humans, needs, water
humans, needs, food
brain, is, organ
heart, is, organ
lungs, is, organ
""",
    "geography": """
africa, is, continent
asia, is, continent
europe, is, continent
america, is, continent
australia, is, continent
france, located_in, europe
japan, located_in, asia
brazil, located_in, america
egypt, located_in, africa
eiffel tower, located_in, paris
paris, located_in, france
pyramids, located_in, egypt
mount everest, located_in, asia
sahara, is, desert
amazon, is, river
pacific, is, ocean
atlantic, is, ocean
alps, is, mountains
""",
}


def triples(*names: str) -> list[tuple[str, str, str, str]]:
    """(pack, subject, relation, object) as the packs spell them."""
    return [(n, *[x.strip() for x in line.split(",")]) for n in names or PACKS for line in PACKS[n].strip().splitlines()]


def pack(spark: SparkSession, *names: str) -> DataFrame:
    """(pack, subject, relation, object) with normalized keys, each triple once; all packs if none is named."""
    df = spark.createDataFrame(triples(*names), "pack string, subject string, relation string, object string")
    return df.select("pack", normalize(F.col("subject")).alias("subject"), "relation", normalize(F.col("object")).alias("object")).distinct()


def profile(packs: DataFrame) -> DataFrame:
    """(pack, relation, facts): what each pack is made of, most common relation first."""
    return packs.groupBy("pack", "relation").agg(F.count("*").alias("facts")).orderBy("pack", F.desc("facts"), "relation")
