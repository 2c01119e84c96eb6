"""Streams: cubes that arrive in a folder, and ranges that follow them."""
