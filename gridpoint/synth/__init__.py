"""Tables made from seeds, with what a faithful reader should find in them, and the training set that they complete."""
