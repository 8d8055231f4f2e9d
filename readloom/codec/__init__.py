"""The binary block archive: bits, Huffman trees and the streams of a block at order 0."""
