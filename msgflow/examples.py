"""Hand-written training examples: what customers of a garden shop might write.

They are only defaults: every operator that appends examples takes a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INTENT_EXAMPLES = {
    "account_management": [
        "the login page rejects my username since the update", "two profiles share my phone number, merge them",
        "erase my profile and everything stored in it", "my login code never reaches my phone",
        "add my partner as a second user of our profile", "which email did i use for my login",
        "the site says my profile is blocked after three wrong logins",
    ],
    "billing_and_refunds": [
        "the rake was charged at full price although it was on sale", "the credit for the returned hose is still missing on my card",
        "can the tax number be printed on the bill", "two amounts left my bank for one purchase",
        "credit my card for the cracked flower pot", "your bill lists a wheelbarrow that was never bought",
        "do you take payment by bank transfer", "how much of the price comes back if the box was opened",
        "the gift card was not deducted from the bill",
    ],
    "complaint": [
        "half of the roses arrived dead and your staff laughed at me", "this shop lied about the guarantee and i am furious",
        "rude phone staff, dirty store, broken mower: shame on you", "the third rotten delivery in a row, an utter disgrace",
        "your advert is a lie, the lamp fell apart within a day", "shame on whoever packed these bulbs so carelessly",
    ],
    "order_management": [
        "make it four bags of soil instead of two", "swap the green bench for the brown one before you pack it",
        "drop the watering can from tonight's basket", "hold back the seeds until i have added a spade",
        "split my basket into two separate purchases", "call off the greenhouse, the landlord said no",
        "put a second pair of gloves into the same basket", "i picked the wrong pot size, swap it for the large one",
    ],
    "order_status": [
        "the tracking page has said packed since tuesday", "on which day will the courier bring the mower",
        "did the courier already try to bring the bench", "the tracking number is unknown to the courier",
        "is the greenhouse still in your depot or on the truck", "the truck passed my street without stopping, when is the next try",
        "how far away is the courier with my tomato plants",
    ],
    "out_of_scope": [
        "which shrubs survive in a shady yard", "does your store sell tickets for the flower show",
        "the weather ruined our picnic yesterday", "are there jobs in your store this summer",
        "recommend a song for gardening", "who won the match last night", "how do i get ants out of a lawn",
        "translate this poem about tulips",
    ],
}

SENTIMENT_EXAMPLES = {
    "Positive/Satisfied": [
        "the roses smell wonderful and the box was lovely", "brilliant advice, my lawn has never been greener",
        "what a pleasant surprise, a free pack of seeds", "the gardener who phoned me was kind and patient",
        "beautiful bench, easy to build, worth every cent", "hardly any wait and nothing broken, lovely work",
        "cannot fault the courier, kind and early", "no regrets, this mower is brilliant",
        "far from dull, the flower show was wonderful",
    ],
    "Neutral": [
        "the hedge is two metres tall", "opening hours on sunday", "does the pump run on battery or mains",
        "my postcode begins with four", "the catalogue lists six kinds of soil", "which aisle holds the nails",
        "is the blue hose longer than the red one", "the parcel weighs nine kilos", "seeds go into the ground in march",
        "how wide is the gate of the greenhouse", "one bag covers ten square metres", "what time does the store close",
    ],
    "Negative/Frustrated": [
        "the hose burst on day one, what a rip off", "rude staff and a filthy store, never again",
        "i am sick of these rotten plants", "everything about this purchase was a nightmare",
        "the mower is useless junk and nobody cares", "far from brilliant, the pump leaks everywhere",
        "hardly lovely when half the roses are dead", "never have i felt so cheated", "no kindness, no patience, just shouting",
        "what a miserable waste of a morning", "disgusting smell, dead fish, broken pump",
    ],
}


def intent_examples(spark: SparkSession) -> DataFrame:
    """(text, routing_intent): some rows for each trained intent."""
    rows = [(text, label) for label, texts in INTENT_EXAMPLES.items() for text in texts]
    return spark.createDataFrame(rows, "text string, routing_intent string")


def sentiment_examples(spark: SparkSession) -> DataFrame:
    """(text, sentiment): some rows for each sentiment, turned-around phrases both ways among them."""
    rows = [(text, label) for label, texts in SENTIMENT_EXAMPLES.items() for text in texts]
    return spark.createDataFrame(rows, "text string, sentiment string")
