"""Name dictionaries, gender inference and name spans in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakspark.functions.expr import literals

# First names, family names, gender lists and suffixes.
MALE = tuple("""Aarav Arjun Vihaan Aditya Vivaan Reyansh Ayaan Krishna Sai Arnav Dhruv Kabir Ritvik Anirudh Harsh Pranav Ishaan Rohan Karthik Manish Suresh Ramesh Mahesh Ganesh
Rajesh Vikram Amit Sumit Rohit Mohit Nikhil Rahul Deepak Ankur Gaurav Varun Tarun Kunal Vishal Akash Sanjay Vijay Ajay Naveen Pavan Chetan Sachin Yogesh Dinesh Rakesh""".split())
FEMALE = tuple("""Aanya Ananya Aadhya Diya Myra Isha Kavya Saanvi Anika Riya Priya Shreya Tanvi Aditi Pooja Neha Meera Nisha Anjali Sunita Rekha Deepika Pallavi Swati Shalini Komal
Jyoti Manisha Rashmi Sneha Divya Sakshi Nikita Kriti Lavanya Simran Bhavna Geeta Radha Archana Shweta Garima Aparna Ritika Sonali Preeti Kanika Namrata Anisha Tanya""".split())
SURNAMES = tuple("""sharma verma patel gupta singh kumar reddy nair menon iyer iyengar desai joshi mehta mishra thakur patil kaur tiwari kulkarni rao kapoor chatterjee banerjee
mukherjee ghosh das sen bose shah pandey chauhan yadav shetty hegde bhat naidu choudhary agarwal jain saxena pillai subramanian krishnan rajan murthy venkatesh gill sandhu dhillon
bhatt trivedi shukla dubey srivastava bajaj malhotra kohli khanna arora sethi""".split())
KNOWN_MALE = tuple("luke george max simon peter robert samuel isaiah yash amit raj vikram umang faraj arjun rohan aarav vihaan aditya sai john james david michael daniel mark paul".split())
KNOWN_FEMALE = tuple("priya neha ananya diya isha riya sara aisha zara mira nisha pooja kavya aditi mary sarah emily emma anna jane alice".split())
FEMALE_ENDS = tuple("ika ita iya isha ashi ushi athi tha dha sha shi chi ya ka ni ti vi ri hi li na ta ha da a i".split())
MALE_ENDS = tuple("esh ash ish ush deep nath kumar raj pal dev ram an ar av aj al in ur en sh ab ek il".split())
TRIGGERS = r"naam|name\s+is|my\s+name\s+is|this\s+is|i\s+am|naa\s+peru|nan\s+hesaru|en\s+peyar|ente\s+peru|mera\s+naam|hamara\s+naam|apna\s+naam|I'm|Im"
AFTER_NAMES = ("hai", "hain", "hu", "hoon", "here")

FIRST = MALE + FEMALE
KNOWN = frozenset(x.lower() for x in FIRST) | frozenset(SURNAMES)
#: The trigger in any case, the name in its own.
TRIGGER = rf"\b(?i:{TRIGGERS})\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
CAPITALISED = r"\b[A-Z][a-z]+\b"


def first_token(value: Column) -> Column:
    return F.lower(F.get(F.split(F.trim(value), r"\s+"), 0))


def is_known(token: Column) -> Column:
    return token.isin(*sorted(KNOWN))


def gender(value: Column) -> Column:
    """M, F or U by lists, then by the first token's ending, which must leave at least two letters."""
    t = first_token(value)
    ends = lambda suffixes: F.exists(literals(suffixes), lambda s: F.endswith(t, s) & (F.length(t) > F.length(s) + 1))
    return F.when(t.isin(*KNOWN_MALE), "M").when(t.isin(*KNOWN_FEMALE), "F").when(ends(FEMALE_ENDS), "F").when(ends(MALE_ENDS), "M").otherwise("U")
