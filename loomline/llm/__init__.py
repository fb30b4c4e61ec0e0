"""Training-data operators: near-duplicates, tokens, chats, shards, secrets, quality, repeats, private data, toxicity
and benchmark leaks. Nothing else in the library imports this subpackage."""
