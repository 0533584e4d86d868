"""The input steps that hold no state, applied to a stream of landed files."""
